"""SQL of the engine's queries, for DuckDB."""

from __future__ import annotations

TOKENS = r"list_filter(string_split_regex(lower(coalesce({text}, '')), '\s+'), lambda x: x <> '')"

USABLE = """(embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
             and len(list_filter(embedding, lambda x: x <> 0)) > 0)"""


def usable_rows(name: str, columns: str = "") -> str:
    return f"(select vec_id, any_value(embedding)::double[] as e {columns} from {name} where {USABLE} group by vec_id)"


def nearest(rows: str, k: int, distance: str, extra: str = "") -> str:
    return f"""
        with u as {rows},
        c as (select q.vec_id as query_id, u.vec_id, round({distance}, 9) as dist from u as q join u on true {extra} where q.vec_id % 20 = 0)
        select query_id, row_number() over (partition by query_id order by dist, vec_id)::int as rank, vec_id, round(dist, 6) as distance
        from c qualify rank <= {k}
    """


L2 = "list_sum(list_transform(list_zip(q.e, u.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
COSINE = "1 - list_cosine_similarity(q.e, u.e)"
EMBEDDINGS = "(select vec_id, embedding::double[] as e from embeddings)"

MMR_STEPS = """c as (select query_id, row_number() over (partition by query_id order by dist, vec_id) as pos, vec_id, e, sq from d qualify pos <= 60),
    pr as (select a.query_id, a.pos as i, b.pos as j, list_cosine_similarity(a.e, b.e) as s from c a join c b on a.query_id = b.query_id),
    r(query_id, step, sel) as (
        select query_id, 1, [arg_min(pos, (-round(sq, 12), pos))] from c group by query_id
        union all
        select x.query_id, x.step + 1, list_append(any_value(x.sel), arg_min(x.pos, (-round(x.v, 12), x.pos)))
        from (select r.query_id, r.step, any_value(r.sel) as sel, c.pos, 0.6 * any_value(c.sq) - 0.4 * max(pr.s) as v
              from r join c on c.query_id = r.query_id join pr on pr.query_id = r.query_id and pr.i = c.pos
              where r.step < 40 and list_contains(r.sel, pr.j) and not list_contains(r.sel, c.pos)
              group by r.query_id, r.step, c.pos) x
        group by x.query_id, x.step),
    f as (select query_id, sel from r where step = 40),
    t as (select query_id, unnest(sel) as pos, generate_subscripts(sel, 1) as mmr_rank from f)"""

MMR = f"""
    with recursive u as {EMBEDDINGS},
    d as (select q.vec_id as query_id, u.vec_id, u.e, list_cosine_similarity(u.e, q.e) as sq, round({L2}, 9) as dist from u as q join u on true where q.vec_id % 20 = 0),
    {MMR_STEPS}
    select t.query_id, t.mmr_rank::int as mmr_rank, c.vec_id from t join c on c.query_id = t.query_id and c.pos = t.pos
"""

WINDOWS = f"""
    with t as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') as w from documents),
    n as (select doc_id, w, case when len(w) <= 480 then 1 else ceil(len(w) / 448.0)::int end as k from t)
"""


def bm25(docs: str, questions: str, k: int) -> str:
    """``docs``: (doc, text); ``questions``: (q, text).  Ends in the table best(q, rank, doc, score)."""
    return f"""
        docs as ({docs}), asked as ({questions}),
        tok as (select doc, unnest({TOKENS.format(text="text")}) as t from docs),
        dl as (select docs.doc, coalesce(c.l, 0) as l from docs left join (select doc, count(*) as l from tok group by doc) c on c.doc = docs.doc),
        st as (select count(*) as n, avg(l) as a from dl),
        tf as (select doc, t, count(*) as f from tok group by 1, 2),
        raw as (select t, count(*) as df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as r from tf cross join st group by t, n),
        idf as (select t, df, case when r < 0 then 0.25 * (select avg(r) from raw) else r end as i from raw),
        qt as (select q, unnest({TOKENS.format(text="text")}) as t from asked),
        sc as (select q, tf.doc, sum(i * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / a))) as s
               from qt join tf on qt.t = tf.t join idf on idf.t = tf.t join dl on dl.doc = tf.doc cross join st group by 1, 2),
        every as (select asked.q, docs.doc, round(coalesce(sc.s, 0), 9) as score from asked cross join docs left join sc on sc.q = asked.q and sc.doc = docs.doc),
        best as (select q, row_number() over (partition by q order by score desc, doc desc)::int as rank, doc, score from every qualify rank <= {k})
    """


DOCS = "select doc_id as doc, text from documents"
ITEMS = "select item_id as q, text from benchmark"

FLAT = r"trim(regexp_replace(coalesce({text}, ''), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"


def snippet(text: str) -> str:
    flat = FLAT.replace("{text}", text)
    space = f"regexp_extract(substr({flat}, 1, 195), '^(.*) ', 1)"
    hyphen = rf"regexp_extract(substr({flat}, 1, 197), '^(.{{1,190}}(?:[\pL_][\pL_]-|[\pL_]-[\pL_]-|.[\pL_][\pL_]-|.[\pL_]-[\pL_]-))[\pL_]-?[\pL_]', 1)"
    head = f"case when length({hyphen}) > length({space}) then {hyphen} else {space} end"
    return f"case when length({flat}) <= 200 then {flat} else ltrim({head} || ' [...]') end"


def label(m: str, number: str) -> str:
    def base(p: str) -> str:
        return f"list_extract(string_split({p}, '/'), -1)"

    flags = ", ".join(f"case when {m}{f} then '{f}' end" for f in ("table_md", "table_json", "table_row", "chartqa", "ocr"))
    return f"""'Source ' || {number} || ': ' ||
        case when coalesce({m}image_path, '') <> '' and coalesce({m}caption, false) then {base(m + "image_path")} || ' (image)'
             else {base(f"coalesce({m}source, {m}image_path, 'unknown')")} end ||
        case when concat_ws('/', {flags}) <> '' then ' (' || concat_ws('/', {flags}) || ')' else '' end"""


CONTEXT = f"""
    with ts as (select vec_id, any_value(document) as document, any_value(metadata) as m from text_store group by vec_id),
    {bm25("select vec_id as doc, document as text from ts", ITEMS, 5)},
    x as (select best.q as query_id, best.rank as number, ts.document, ts.m, asked.text as question
          from best join ts on ts.vec_id = best.doc join asked on asked.q = best.q)
"""

LABELLED = ("source", "image_path", "caption", "table_md", "table_json", "table_row", "chartqa", "ocr")

ASK = f"""
    with recursive ts as (select vec_id, any_value(document) as document, any_value(metadata) as m, any_value(embedding)::double[] as e from text_store where {USABLE} group by vec_id),
    im as (select vec_id, any_value(image_path) as image_path, any_value(embedding)::double[] as e from image_store where {USABLE} group by vec_id),
    items as (select item_id as q, trim(text, ' ') as text from benchmark where trim(coalesce(text, ''), ' ') <> ''),
    ht as (select q, unnest({TOKENS.format(text="text")}) as t from items),
    hh as (select q, ('0x' || substr(md5(t), 1, 8))::ubigint as h from ht),
    hv as (select q, (h % 64)::int as pos, sum(case when (h // 64) % 2 = 0 then 1 else -1 end) as x from hh group by 1, 2),
    hz as (select q, sqrt(sum(x * x)) as norm from hv group by q),
    qv as (select hz.q, list((coalesce(x, 0) / norm)::float::double order by g.i) as e from hz cross join range(0, 64) as g(i) left join hv on hv.q = hz.q and hv.pos = g.i group by hz.q),
    d as (select q.q as query_id, u.vec_id, u.e, list_cosine_similarity(u.e, q.e) as sq, round({L2}, 9) as dist from qv as q join ts as u on true),
    {MMR_STEPS},
    {bm25("select vec_id as doc, document as text from ts", "select q, text from items", 10)},
    lists as (select t.query_id, 0 as l, t.mmr_rank as rank, c.vec_id from t join c on c.query_id = t.query_id and c.pos = t.pos union all select q, 1, rank, doc from best),
    placed as (select query_id, vec_id, row_number() over (partition by query_id order by l, rank) as in_pos from lists),
    tokens as (select query_id, in_pos, document, m, list_distinct({TOKENS.format(text="items.text")}) as a, list_distinct({TOKENS.format(text="ts.document")}) as b
               from placed join items on items.q = placed.query_id join ts on ts.vec_id = placed.vec_id),
    scored as (select query_id, in_pos, document, m, round(case when len(a) > 0 and len(b) > 0 then len(list_intersect(a, b)) / sqrt(len(a) * len(b)) else 0 end, 9) as score from tokens),
    texts as (select query_id, row_number() over (partition by query_id order by score desc, in_pos) as rank, document, m from scored qualify rank <= 10),
    pictures as (select q.q as query_id, row_number() over (partition by q.q order by round({L2}, 9), u.vec_id) as rank, u.image_path from qv as q join im as u on true qualify rank <= 2),
    every_one as (
        select query_id, 0 as l, rank, document, {", ".join(f"m.{x} as {x}" for x in LABELLED)} from texts
        union all
        select query_id, 1, rank, '', null, image_path, null, null, null, null, null, null from pictures),
    x as (select every_one.*, row_number() over (partition by query_id order by l, rank) as number, items.text as question from every_one join items on items.q = query_id)
    select query_id,
        chr(10) || '🔎 Retrieved context:' || chr(10) || string_agg('  ' || number || '. ' || {label("x.", "number")} || ' — ' ||
            case when coalesce(x.image_path, '') <> '' then '<image>' else {snippet("document")} end, chr(10) order by number) as listing,
        'You are a helpful assistant. Use ONLY the sources below.' || chr(10) || chr(10) || 'User question: ' || question || chr(10) || chr(10) ||
            string_agg({label("x.", "number")} || chr(10) || case when coalesce(x.image_path, '') <> '' then '<image at ' || x.image_path || '>' else coalesce(document, '') end,
                       chr(10) || chr(10) order by number) || chr(10) || chr(10) || 'Cite facts like (Source 2).' as prompt
    from x group by query_id, question
"""

REGION_TABLES = """
    r as (select n_regionkey, n_nationkey, n_nationkey::varchar as k, case when n_nationkey % 3 = 0 then null else n_name end as v from nation)
"""

SQL: dict[str, str] = {
    "knn_l2_top60": nearest(EMBEDDINGS, 60, L2),
    "knn_cosine_top60": nearest(EMBEDDINGS, 60, COSINE),
    "batch_knn": nearest(usable_rows("text_store"), 5, COSINE, "and q.vec_id <> u.vec_id"),
    "image_knn_top2": nearest(usable_rows("image_store"), 2, L2),
    "mmr_top40": MMR,
    "mean_pool_by_label": """
        select label, (i - 1)::int as pos, round(avg(embedding[i]::double), 6) as mean from embeddings, range(1, 65) as g(i) group by label, i
    """,
    "embed_documents": f"""
        {WINDOWS},
        w as (select doc_id, g as window_ix, w[g * 448 + 1 : g * 448 + 480] as win from n, unnest(range(0, k)) as u(g)),
        tok as (select doc_id, window_ix, unnest(list_transform(win, lambda x: lower(x))) as t from w),
        h as (select doc_id, window_ix, ('0x' || substr(md5(t), 1, 8))::ubigint as h from tok),
        v as (select doc_id, window_ix, (h % 64)::int as pos, sum(case when (h // 64) % 2 = 0 then 1 else -1 end) as x from h group by 1, 2, 3),
        z as (select doc_id, window_ix, sqrt(sum(x * x)) as norm from v group by 1, 2),
        p as (select v.doc_id, v.pos, sum((x / norm)::float::double) as s from v join z using (doc_id, window_ix) where norm > 0 group by 1, 2)
        select n.doc_id, i::int as pos, round((coalesce(p.s, 0) / n.k)::float::double, 6) as value
        from n cross join range(0, 64) as g(i) left join p on p.doc_id = n.doc_id and p.pos = i
    """,
    "token_windows": f"""
        {WINDOWS}
        select doc_id, g::int as window_ix, len(w[g * 448 + 1 : g * 448 + 480])::int as n_tokens, md5(array_to_string(w[g * 448 + 1 : g * 448 + 480], ' ')) as digest
        from n, unnest(range(0, k)) as u(g)
    """,
    "window_counts": f"{WINDOWS} select doc_id, k::int as windows from n",
    "bm25_term_stats": f"with {bm25(DOCS, ITEMS, 10)} select t as term, df, round(i, 6) as idf from idf",
    "bm25_doc_len": f"select doc_id, len({TOKENS.format(text='text')})::int as dl from documents",
    "bm25_batch": f"with {bm25(DOCS, ITEMS, 10)} select q as item_id, rank, doc as doc_id, round(score, 6) as score from best",
    "rerank_top10": f"""
        with {bm25(DOCS, ITEMS, 40)},
        x as (select best.q, best.doc, best.rank as in_pos, list_distinct({TOKENS.format(text="asked.text")}) as a, list_distinct({TOKENS.format(text="docs.text")}) as b
              from best join asked on asked.q = best.q join docs on docs.doc = best.doc),
        y as (select q, doc, in_pos, round(case when len(a) > 0 and len(b) > 0 then len(list_intersect(a, b)) / sqrt(len(a) * len(b)) else 0 end, 9) as score from x)
        select q as item_id, row_number() over (partition by q order by score desc, in_pos)::int as rank, doc as doc_id, round(score, 6) as score from y qualify rank <= 10
    """,
    "hybrid_fuse": f"""
        with u as {usable_rows("text_store", ", any_value(document) as document")},
        near as (select q.vec_id as query_id, u.vec_id, round({COSINE}, 9) as dist from u as q join u on true where q.vec_id % 20 = 0),
        a as (select query_id, 0 as l, row_number() over (partition by query_id order by dist, vec_id) as rank, vec_id from near qualify rank <= 10),
        {bm25("select vec_id as doc, document as text from u", "select vec_id as q, document as text from u where vec_id % 20 = 0", 10)},
        every as materialized (select * from a union all select q, 1, rank, doc from best)
        select query_id, row_number() over (partition by query_id order by l, rank)::int as in_pos, case l when 0 then 'vectors' else 'words' end as src, vec_id from every
    """.replace("every as materialized", "fusedlists as").replace("vec_id from every", "vec_id from fusedlists"),
    "source_labels": f"""
        with r as (select distinct rec_id, source, image_path, page, table_md, table_json, table_row, caption, chartqa, ocr from doc_records)
        select rec_id, {label("r.", "rec_id")} as label from r
    """,
    "snippets": f"with r as (select rec_id, any_value(page_content) as t from doc_records group by rec_id) select rec_id, {snippet('t')} as snippet from r",
    "context_listing": f"""
        {CONTEXT}
        select query_id, chr(10) || '🔎 Retrieved context:' || chr(10) || string_agg('  ' || number || '. ' || {label("m.", "number")} || ' — ' ||
            case when coalesce(m.image_path, '') <> '' then '<image>' else {snippet("document")} end, chr(10) order by number) as listing
        from x group by query_id
    """,
    "prompt_build": f"""
        {CONTEXT}
        select query_id, 'You are a helpful assistant. Use ONLY the sources below.' || chr(10) || chr(10) || 'User question: ' || question || chr(10) || chr(10) ||
            string_agg({label("m.", "number")} || chr(10) || case when coalesce(m.image_path, '') <> '' then '<image at ' || m.image_path || '>' else coalesce(document, '') end,
                       chr(10) || chr(10) order by number) || chr(10) || chr(10) || 'Cite facts like (Source 2).' as prompt
        from x group by query_id, question
    """,
    "ask_batch": ASK,
    "collection_counts": f"""
        select 'text_store' as collection, count(*) as n_rows, count(distinct vec_id) as n_ids, count(distinct case when {USABLE} then vec_id end) as n_usable from text_store
        union all
        select 'image_store', count(*), count(distinct vec_id), count(distinct case when {USABLE} then vec_id end) from image_store
    """,
    "file_type_dispatch": r"""
        select file_id, case when regexp_extract(lower(path), '\.([^./]+)$', 1) in ('png', 'jpg', 'jpeg', 'jpe', 'gif', 'bmp', 'tif', 'tiff', 'webp', 'svg') then 'image'
                             when lower(path) like '%.pdf' then 'pdf' when lower(path) like '%.txt' or lower(path) like '%.md' then 'text' end as kind
        from source_files
    """,
    "image_text_fusion": """
        with s as (select file_id, list_extract(string_split(path, '/'), -1) as cap, case when file_id % 3 = 0 then '' else coalesce(mime, '') end as chart,
                          case when file_id % 2 = 0 then path else '' end as ocr from source_files)
        select file_id, concat_ws(' • ', nullif(cap, ''), nullif(chart, ''), nullif(ocr, '')) as content, chart <> '' as chartqa, ocr <> '' as ocr from s
    """,
    "table_markdown": f"""
        with {REGION_TABLES}
        select n_regionkey, '| key | name |' || chr(10) || '|---|---|' || chr(10) ||
               string_agg('| ' || k || ' | ' || coalesce(v, '') || ' |' || chr(10), '' order by n_nationkey) as content
        from r group by n_regionkey
    """,
    "table_json": f"""
        with {REGION_TABLES}
        select n_regionkey, '{{"headers":["key","name"],"rows":[' ||
               string_agg('["' || k || '",' || coalesce('"' || v || '"', 'null') || ']', ',' order by n_nationkey) || ']}}' as content
        from r group by n_regionkey
    """,
    "table_row_sentences": f"""
        with {REGION_TABLES}
        select n_regionkey, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int as row_ix, 'Row -> key: ' || k || ', name: ' || coalesce(v, '') as sentence
        from r
    """,
    "chat_turns": """
        with c as (select conv_id, turn, any_value(role) as role, any_value(text) as text from conversations group by 1, 2)
        select conv_id, row_number() over (partition by conv_id order by turn)::int as place, role, trim(text, ' ') as content from c where trim(coalesce(text, ''), ' ') <> ''
    """,
}
