"""The contract queries ``opN_<name>``: each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelspark.llm import alignment, decontam, html_text, langid, lexical, line_dedup, minhash, prefix_counts, quality, rank_bpe, records, secrets, sharding
from parcelspark.llm.common import table


def op1_boosted_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_fused_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op3_winnowed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("key")


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op5_consensus_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).drop("text_key")


def op8_entropy_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op9_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.round_trip(table(spark, sf_dir, "documents"))


def op10_indexed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_report(table(spark, sf_dir, "documents"))


def op11_twice_seen_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op12_packed_pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


def op13_blocked_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_boosted_quality_rules,
        op2_fused_language_id,
        op3_winnowed_decontamination,
        op4_extendible_sharding,
        op5_consensus_page_text,
        op6_prefix_token_counts,
        op7_circulant_minhash,
        op8_entropy_secret_scan,
        op9_rank_array_bpe,
        op10_indexed_records,
        op11_twice_seen_line_dedup,
        op12_packed_pair_alignment,
        op13_blocked_product_search,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE_SQL: dict[str, str] = {
    "op11_twice_seen_line_dedup": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS every FROM documents),
        lines AS (SELECT r, doc_id, unnest(every) AS line, generate_subscripts(every, 1) AS i FROM docs),
        keyed AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
        repeats AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
        marked AS (SELECT k.*, p.keeper IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id < p.keeper) AS gone FROM keyed k LEFT JOIN repeats p USING (key))
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY r""",
    "op13_blocked_product_search": rf"""
        WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERM}')) AS term FROM (SELECT row_number() OVER () AS r, * FROM documents)),
        d AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY r),
        s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
        q AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERM}')) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
        p AS (SELECT term, r, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY term, r),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, docs),
        found AS (
            SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
            FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), s GROUP BY i, item_id, r, doc_id
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM found WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op3_winnowed_decontamination": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS w FROM benchmark),
        i AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
        spots AS (SELECT r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win))),
        hits AS (SELECT r, n, s, item FROM spots JOIN win USING (n, x)),
        words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op7_circulant_minhash": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^ \t-\r]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + least(3, len(w)) - 1), ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS mutual FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * mutual >= 85 * (p.size + q.size - mutual)),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(size, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
