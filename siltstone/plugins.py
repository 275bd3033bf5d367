"""Model plug-ins, each with a deterministic offline stand-in.

A plug-in is an object that can be pickled: it is sent to the tasks, and loads
whatever it needs there, once for each worker process.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import os
import urllib.request
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[str]: ...

    def decode(self, tokens: Sequence[str]) -> str: ...


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class ImageEmbedder(Protocol):
    """Vectors of images and of texts in one space."""

    name: str
    dim: int

    def embed_images(self, contents: list[bytes]) -> np.ndarray: ...

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Generator(Protocol):
    def answer(self, prompt: str) -> str: ...


class ImageReader(Protocol):
    """Text of an image: caption, chart as text, recognised characters; '' where there is none."""

    def read(self, content: bytes) -> tuple[str, str, str]: ...


class PdfReader(Protocol):
    def text(self, content: bytes) -> str: ...

    def tables(self, content: bytes) -> list[tuple[int, list[list[list[str | None]]]]]:
        """(page from 1, its tables), a table being rows of cells."""


class WhitespaceTokenizer:
    """Tokens are runs of non-blank characters."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def decode(self, tokens: Sequence[str]) -> str:
        return " ".join(tokens)


class FileTokenizer:
    """A public tokenizer's file; the path is a parameter."""

    def __init__(self, path: str):
        self.path = path

    def encode(self, text: str) -> list[int]:
        return _tokenizer_file(self.path).encode(text, add_special_tokens=False).ids

    def decode(self, tokens: Sequence[int]) -> str:
        return _tokenizer_file(self.path).decode(list(tokens))


@lru_cache(maxsize=2)
def _tokenizer_file(path: str):
    from tokenizers import Tokenizer as File

    return File.from_file(path)


@lru_cache(maxsize=200_000)
def _slot(token: str, dim: int) -> tuple[int, float]:
    h = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
    return h % dim, 1.0 if (h // dim) % 2 == 0 else -1.0


class HashEmbedder:
    """Signed feature hashing of lower-cased tokens, normalised to length 1 (a blank text stays zero)."""

    def __init__(self, dim: int = 64):
        self.name, self.dim = f"hash-{dim}", dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, t in zip(out, texts):
            for token in t.lower().split():
                k, sign = _slot(token, self.dim)
                row[k] += sign
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class OverlapReranker:
    """Shared distinct tokens over the geometric mean of both sides' numbers of distinct tokens."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, d in pairs:
            a, b = set(q.lower().split()), set(d.lower().split())
            out.append(len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0)
        return out


class EchoGenerator:
    """Answers with the first source of the prompt; for tests and offline use."""

    def answer(self, prompt: str) -> str:
        blocks = prompt.split("\n\n")
        return blocks[2] if len(blocks) > 3 else ""


class ByteHashImages(HashEmbedder):
    """Offline stand-in for an image model: signed hashing of the contents' runs of four bytes; texts as in :class:`HashEmbedder`.

    Equal images are equal and like ones near, but no text is near an image for
    what it shows.
    """

    def embed_images(self, contents: list[bytes]) -> np.ndarray:
        out = np.zeros((len(contents), self.dim))
        for row, c in zip(out, contents):
            data = np.frombuffer(c or b"", np.uint8).astype(np.uint64)
            if not len(data):
                continue
            data = np.append(data, np.zeros(3, np.uint64))
            runs = data[:-3] | data[1:-2] << np.uint64(8) | data[2:-1] << np.uint64(16) | data[3:] << np.uint64(24)
            h = runs * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            np.add.at(row, (h % np.uint64(self.dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class NoImages:
    def read(self, content: bytes) -> tuple[str, str, str]:
        raise RuntimeError("no reader of images is given")


class NoPdf:
    """Reads nothing; a file that can't be read is an empty document with its error, without tables."""

    def text(self, content: bytes) -> str:
        raise RuntimeError("no reader of PDF files is given")

    def tables(self, content: bytes) -> list:
        raise RuntimeError("no reader of PDF files is given")


# Adapters to public libraries, which are loaded in the tasks, once for each worker process, and only if they are used.


@lru_cache(maxsize=8)
def _loaded(kind: str, model: str):
    if kind == "clip":
        from transformers import CLIPModel, CLIPProcessor

        return CLIPModel.from_pretrained(model).eval(), CLIPProcessor.from_pretrained(model)
    if kind in ("image-to-text", "visual-question-answering"):
        from transformers import pipeline

        return pipeline(kind, model=model)
    if kind == "ocr":
        import easyocr

        return easyocr.Reader(model.split("+"))
    if kind == "cross-encoder":
        from sentence_transformers import CrossEncoder

        return CrossEncoder(model)
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(model)


def _picture(content: bytes):
    from PIL import Image

    return Image.open(io.BytesIO(content)).convert("RGB")


class PypdfReader:
    """Text by pypdf (pages joined by a line feed), tables by pdfplumber."""

    def text(self, content: bytes) -> str:
        import pypdf

        return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages)

    def tables(self, content: bytes) -> Iterator[tuple[int, list]]:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            for number, page in enumerate(pdf.pages, 1):
                yield number, page.extract_tables()


class ModelImages:
    """Caption and chart text by image-to-text models, characters by easyocr; a part whose model is None stays empty."""

    def __init__(self, caption: str | None, chart: str | None = None, languages: str | None = "en"):
        self.caption, self.chart, self.languages = caption, chart, languages

    def read(self, content: bytes) -> tuple[str, str, str]:
        picture = _picture(content)
        said = [_loaded("image-to-text", m)(picture)[0]["generated_text"].strip() if m else "" for m in (self.caption, self.chart)]
        ocr = " ".join(_loaded("ocr", self.languages).readtext(np.asarray(picture), detail=0, paragraph=True)).strip() if self.languages else ""
        return said[0], said[1], ocr


class ClipImages:
    """A CLIP model: images and texts in one space."""

    def __init__(self, model: str, dim: int = 512):
        self.name, self.model, self.dim = model, model, dim

    def embed_images(self, contents: list[bytes]) -> np.ndarray:
        model, processor = _loaded("clip", self.model)
        return model.get_image_features(**processor(images=[_picture(c) for c in contents], return_tensors="pt")).detach().numpy()

    def embed(self, texts: list[str]) -> np.ndarray:
        model, processor = _loaded("clip", self.model)
        return model.get_text_features(**processor(text=texts, return_tensors="pt", padding=True, truncation=True)).detach().numpy()


class SentenceEmbedder:
    def __init__(self, model: str, dim: int):
        self.name, self.model, self.dim = model, model, dim

    def embed(self, texts: list[str]) -> np.ndarray:
        return _loaded("sentence", self.model).encode(texts)


class PairReranker:
    def __init__(self, model: str):
        self.model = model

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [float(s) for s in _loaded("cross-encoder", self.model).predict(pairs)]


class HttpGenerator:
    """A service with the widespread chat-completions interface; ``key`` names the environment variable that holds its key."""

    def __init__(self, url: str, model: str, *, temperature: float = 0.2, key: str | None = None, timeout: float = 120.0):
        self.url, self.model, self.temperature, self.key, self.timeout = url, model, temperature, key, timeout

    def answer(self, prompt: str) -> str:
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ[self.key]}"} if self.key else {})
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]
