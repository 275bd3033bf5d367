"""The pN_ queries over the test tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import leakage, neardup, neighbours, packing, quality, residue, scans, splitting, terms
from siltstone.llm.common import unflagged
from siltstone.session import table


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_vectors(table(spark, d, "text_store"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(p1_neighbours(spark, d), 0.9)


def near_records(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    records = table(spark, d, "doc_records").where(unflagged(images=False))
    return neardup.near_duplicates(records, width=3, threshold=0.6, least_words=40)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_records(spark, d).groups().withColumnRenamed("id", "rec_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_records(spark, d).pairs().select(F.col("a").alias("rec_a"), F.col("b").alias("rec_b"))


def p3_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "doc_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "doc_records").where(unflagged(images=False))
    return quality.not_prose(quality.text_statistics(records))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "doc_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_sections(table(spark, d, "doc_records"))


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "doc_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_terms(spark, d).where(F.col("mark").isNotNull()).select("term", "mark")


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    of_pdf = F.lower(F.col("source")).endswith(".pdf")
    every = table(spark, d, "doc_records")
    records = every.where(unflagged(images=True) & (F.coalesce(F.col("ocr"), F.lit(False)) | F.coalesce(of_pdf, F.lit(False))))
    return scans.repair_scans(records, corpus=every)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise_kinds(p6_repaired(spark, d))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversized(p7_pack(spark, d)).withColumn("doc_id", F.col("doc_id").cast("long"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_phrases(spark: SparkSession, d: str) -> DataFrame:
    exact = leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "benchmark"), near_gap=0)
    return exact.drop("kind")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_phrases(spark, d).select("doc_id", "item_id").distinct()


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.template_residue(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_kinds(spark, d).select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_neighbours, p2_found, p2_groups, p3_found, p3_stats, p4_found, p4_pieces, p5_found, p5_terms, p6_found, p6_repaired, p7_found, p7_pack, p8_found, p8_passages, p8_phrases, p9_found, p9_kinds,
    )
}

TERMS_SQL = """
    with r as (select rec_id, any_value(page_content) as t from doc_records where page_content is not null group by rec_id),
    w as (select rec_id, unnest(regexp_extract_all(lower(t), '[a-z]{3,}')) as term from r),
    c as (select term, count(*) as occurrences, count(distinct rec_id) as records from w group by term),
    m as (select term, occurrences::bigint as occurrences, records::bigint as records,
                 case when records <= 2 then 'rare' when records > 0.2 * (select count(*) from r) then 'common' end as mark from c)
"""

USABLE_SQL = """
    u as (select vec_id, any_value(embedding)::double[] as e from text_store
          where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
                and len(list_filter(embedding, lambda x: x <> 0)) > 0
          group by vec_id),
    c as (select a.vec_id, b.vec_id as neighbour_id, round(list_cosine_similarity(a.e, b.e), 6) as cosine
          from u a join u b on a.vec_id <> b.vec_id),
    n as (select vec_id, row_number() over (partition by vec_id order by cosine desc, neighbour_id)::int as rank, neighbour_id, cosine
          from c qualify rank <= 5)
"""

SIMILAR_SQL = """
    r as (select rec_id, regexp_extract_all(lower(any_value(page_content)), '[a-z0-9]+') as w from doc_records
          where image_path is null and page_content is not null and not coalesce(table_md, false)
                and not coalesce(table_json, false) and not coalesce(table_row, false) group by rec_id),
    s as (select distinct rec_id, array_to_string(w[p : p + 2], ' ') as g
          from (select rec_id, w, unnest(range(1, len(w) - 1)) as p from r where len(w) >= 40)),
    z as (select rec_id, count(*) as n from s group by rec_id),
    i as (select a.rec_id as rec_a, b.rec_id as rec_b, count(*) as k from s a join s b on a.g = b.g and a.rec_id < b.rec_id group by 1, 2),
    p as (select rec_a, rec_b from i join z x on x.rec_id = rec_a join z y on y.rec_id = rec_b where k >= 0.6 * (x.n + y.n - k))
"""

SQL: dict[str, str] = {
    "p1_found": f"""with {USABLE_SQL} select distinct least(vec_id, neighbour_id) as vec_a, greatest(vec_id, neighbour_id) as vec_b
        from n where cosine >= 0.9""",
    "p1_neighbours": f"with {USABLE_SQL} select vec_id, rank, neighbour_id, cosine from n",
    "p2_found": f"with {SIMILAR_SQL} select rec_a, rec_b from p",
    "p2_groups": f"""
        with recursive {SIMILAR_SQL},
        b as (select rec_a as x, rec_b as y from p union all select rec_b, rec_a from p),
        walk(x, y) as (select x, y from b union select walk.x, b.y from walk join b on walk.y = b.x),
        c as (select rec_id, list(g order by g) as gs from s group by rec_id)
        select rec_id, min(rec_id) over (partition by gs) as class_id, least(rec_id, coalesce((select min(y) from walk where x = rec_id), rec_id)) as group_id from c
    """,
    "p4_found": """
        with recursive r as (select rec_id, any_value(page_content) as t from doc_records where page_content is not null group by rec_id),
        l as (select rec_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from r),
        b as (select rec_id, i, line, trim(line, ' ' || chr(9) || chr(13) || chr(10)) as bare from l),
        k as (select *, case when bare like '```%' then 1 when bare like '~~~%' then 2 else 0 end as f from b),
        s as (
            select rec_id, 0::bigint as i, 0 as fence, 0 as section_no, false as header from r
            union all
            select k.rec_id, k.i, case when s.fence = 0 then k.f when k.f = s.fence then 0 else s.fence end,
                   s.section_no + (s.fence = 0 and k.f = 0 and regexp_matches(bare, '^#{1,3}( |$)'))::int, s.fence = 0 and k.f = 0 and regexp_matches(bare, '^#{1,3}( |$)')
            from s join k on k.rec_id = s.rec_id and k.i = s.i + 1),
        x as (select s.rec_id, s.section_no, string_agg(k.line, chr(10) order by k.i) as body from s join k on k.rec_id = s.rec_id and k.i = s.i where not s.header group by 1, 2)
        select rec_id, section_no from x where length(trim(body, ' ' || chr(9) || chr(13) || chr(10))) > 800
    """,
    "p5_terms": TERMS_SQL + "select term, occurrences, records, mark from m",
    "p5_found": TERMS_SQL + "select term, mark from m where mark is not null",
    "p7_found": r"select distinct doc_id from documents where len(regexp_extract_all(text, '[^ \t\r\n]+')) > 480",
    "p8_phrases": """
        with d as (select distinct doc_id, text from documents where text is not null),
        i as (select distinct item_id, text from benchmark where text is not null),
        dw as (select doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') as w from d),
        iw as (select item_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') as w from i),
        ig as (select item_id, text, array_to_string(w[q : q + 11], ' ') as g, q from (select *, unnest(range(1, len(w) - 10)) as q from iw)),
        dg as (select doc_id, text, array_to_string(w[p : p + 11], ' ') as g, p from (select *, unnest(range(1, len(w) - 10)) as p from dw)),
        m as (select doc_id, dg.text as dt, item_id, ig.text as it, p, q, p - row_number() over (partition by doc_id, dg.text, item_id, ig.text, p - q order by p) as island
              from dg join ig using (g))
        select distinct doc_id, item_id, (count(*) + 11)::int as words, (min(p) - 1)::int as doc_word, (min(q) - 1)::int as item_word
        from m group by doc_id, dt, item_id, it, p - q, island
    """,
    "p8_found": """
        with d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents where text is not null),
        i as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from benchmark where text is not null),
        ig as (select distinct item_id, array_to_string(w[p : p + 11], ' ') as g
               from (select item_id, w, unnest(range(1, len(w) - 10)) as p from i)),
        dg as (select doc_id, array_to_string(w[p : p + 11], ' ') as g
               from (select doc_id, w, unnest(range(1, len(w) - 10)) as p from d))
        select distinct doc_id, item_id from dg join ig using (g)
    """,
}
