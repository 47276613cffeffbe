"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.shared import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op3_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.packing import pack_tokens

    return pack_tokens(_table(spark, sf_dir, "documents"), _tokenizer())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer())


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.mixing import mixing_rates

    return mixing_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.url_rules import url_verdicts

    return url_verdicts(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.substring_dedup import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.near_dedup import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def check_op3_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose packed segments don't add up to their tokens, or don't follow each other without a gap: none."""
    from maskwright.llm.packing import pack_tokens
    from maskwright.llm.token_counts import count_tokens

    docs = _table(spark, sf_dir, "documents")
    cells = F.arrays_zip("doc_ids", "token_starts", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("a"), F.slice("cu_seqlens", F.lit(2), F.size("doc_ids")).alias("b"))
    parts = pack_tokens(docs, _tokenizer()).select(F.explode(cells).alias("c")).select(F.col("c.doc_ids").alias("doc_id"), F.col("c.token_starts").alias("start"), (F.col("c.b") - F.col("c.a")).alias("n"))
    packed = parts.groupBy("doc_id").agg(F.sum("n").alias("packed"), F.max(F.col("start") + F.col("n")).alias("last"), F.min("start").alias("first"))
    both = count_tokens(docs, _tokenizer()).select("doc_id", "n_tokens").join(packed, "doc_id", "full")
    odd = "coalesce(n_tokens, 0) <> coalesce(packed, 0) or coalesce(last, 0) <> coalesce(packed, 0) or coalesce(first, 0) <> 0"
    return both.filter(odd).select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.coalesce("packed", F.lit(0)).cast("long").alias("packed"))


def check_op4_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that documents hold word for word."""
    return op4_decontaminate(spark, sf_dir).filter("score = 1").select("doc_id", "item_id").distinct()


def check_op6_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and listed rule of each page, and the verdict where a listed rule decides."""
    return op6_url_rules(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def check_op8_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans: their counts and digest."""
    return op8_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def check_op9_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_pack_tokens": op3_pack_tokens,
        "op4_decontaminate": op4_decontaminate,
        "op5_quality": op5_quality,
        "op6_url_rules": op6_url_rules,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_personal_data": op8_personal_data,
        "op9_token_counts": op9_token_counts,
        "op10_near_dedup": op10_near_dedup,
        "check_op3_lossless": check_op3_lossless,
        "check_op4_whole": check_op4_whole,
        "check_op6_listed": check_op6_listed,
        "check_op8_base": check_op8_base,
        "check_op9_bytes": check_op9_bytes,
    }


_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
#: Kind, expression and test of the base spans.
_BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: p::HUGEINT > 255)) = 0"),
    (
        "card",
        r"[0-9](?:[\x20-]?[0-9])+",
        f"length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9][((length({_DIGITS}) - i) % 2 * 10 + substr({_DIGITS}, i, 1)::INT + 1)::INT])) % 10 = 0",
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
)


def _base_spans_sql() -> str:
    """Each kind's matches with their places: a match begins after the pieces and matches before it."""
    kinds = []
    for k, (name, regex, ok) in enumerate(_BASE):
        found = f"SELECT doc_id, regexp_split_to_array(t, '{regex}') AS parts, regexp_extract_all(t, '{regex}') AS hits FROM d"
        sizes = "list_transform(range(1, len(hits) + 1), lambda i: length(parts[i]) + CASE WHEN i > 1 THEN length(hits[i - 1]) ELSE 0 END)"
        rows = f"SELECT doc_id, unnest(hits) AS m, unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(sizes[1:i]))) AS a FROM (SELECT doc_id, hits, {sizes} AS sizes FROM ({found})) WHERE len(hits) > 0"
        kinds.append(f"SELECT doc_id, {k} AS k, '{name}:' || a::BIGINT || ':' || (a + length(m))::BIGINT AS span, a FROM ({rows}) WHERE {ok}")
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{name}" for k, (name, _, _) in enumerate(_BASE))
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(kinds)})
        SELECT doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY a, k), '')) AS base_sha256 FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id"""


def _listed_sql() -> str:
    from maskwright.llm.url_rules import LISTED

    host = "translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    rules = " UNION ALL ".join(f"SELECT '{h}' AS h, '{p}' AS p, '{v}' AS v" for h, p, v in LISTED)
    return f"""
        WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce({host}, '') AS host, coalesce({path}, '') AS path FROM pages),
             f AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
                   FROM u JOIN ({rules}) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
        SELECT page_id, host, path, rule, verdict FROM u LEFT JOIN f USING (r)"""


def oracle_sql() -> dict[str, str]:
    spaced = lambda c: f"' ' || trim(regexp_replace({_LOW(c)}, '[\\x20\\x09-\\x0D]+', ' ', 'g')) || ' '"
    return {
        "check_op3_lossless": "SELECT doc_id, cast(0 AS BIGINT) AS n_tokens, cast(0 AS BIGINT) AS packed FROM documents WHERE false",
        "check_op4_whole": f"SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, {spaced('text')} AS t FROM documents) JOIN (SELECT item_id, {spaced('text')} AS q FROM benchmark) ON length(trim(q)) > 0 AND contains(t, q)",
        "check_op6_listed": _listed_sql(),
        "check_op8_base": _base_spans_sql(),
        "check_op9_bytes": "SELECT doc_id, cast(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents",
        "op2_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
                 g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
            SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
            FROM n JOIN g USING (t)""",
        "op10_near_dedup": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            s AS (
                SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
            l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
            r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
            SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, w.doc_id = min(r.b) AS kept
            FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id""",
    }
