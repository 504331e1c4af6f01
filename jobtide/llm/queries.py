"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtide.llm import (
    bpe, decontaminate, html_extract, lexical_search, license_scan, merkle, near_dedup, packing, pii, quality_classifier,
    quality_rules, secret_scan, substring_dedup,
)
from jobtide.llm.common import sha256_of, table

def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs.select("doc_id", "text"), model).select(
        "doc_id", *[f"rules.{name}" for name in quality_rules.BASE], "rules.base_failed", "rules.kept", "rules.content_words")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(doc_id):
        return F.crc32(doc_id.cast("string").cast("binary")) % 3

    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), usable=part(F.col("doc_id")) != 1)
    return quality_classifier.score(docs, model).select(
        "doc_id", F.coalesce(part(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = tuple(rule.kind for rule in secret_scan.BASE_RULES)
    spans = F.col("secrets")
    counts = [F.size(F.filter(spans, _of_kind(kind))).cast("bigint").alias(f"n_{kind}") for kind in base]
    return secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *counts, sha256_of(secret_scan.joined(spans, base)).alias("base_sha256"),
        secret_scan.joined(spans).alias("spans"))


def _of_kind(kind: str) -> Callable:
    return lambda span: span["kind"] == kind


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("leak.runs", F.lit(0).cast("bigint"), lambda n, run: n + run["last"] - run["first"] + 1)
    return found.select(
        "doc_id", "leak.n_words", n_hit.alias("n_hit"), F.size("leak.items").cast("bigint").alias("n_items"),
        sha256_of(F.array_join("leak.items", ",")).alias("items_sha256"), (F.size("leak.runs") > 0).alias("contaminated"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), bpe.load_vocabulary(public_tokenizers.path(corpus_pipeline.VOCABULARY)))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = pii.find_pii(table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s["plain"])
    counts = [F.size(F.filter(plain, _of_kind(kind))).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, sha256_of(text_of(plain)).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(corpus_pipeline.VOCABULARY)).drop("ids")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest("segments").alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_rules, op2_quality_classifier, op3_license_scan, op4_secret_scan, op5_decontaminate, op6_substring_dedup, op7_bpe,
    op8_pii, op9_near_dedup, op10_html_extract, op11_lexical_search, op12_packing, op13_merkle_manifest, pipeline)}


def _secret_sql() -> str:
    """The scan without an index: pieces and matches of each expression give its spans."""
    parts = []
    for place, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
  SELECT r, {place} AS place, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(found) + 1), lambda i: {{
      'first': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0),
      'size': length(found[i]), 'counted': length(counted[i])}})) AS m
  FROM (SELECT r, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found,
               regexp_extract_all(text, '{pattern}', {rule.group}) AS counted FROM d WHERE regexp_matches(text, '{pattern}'))
""")
    counts = ", ".join(f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in secret_scan.BASE_RULES)
    least = " ".join(f"WHEN {place} THEN {rule.at_least}" for place, rule in enumerate(secret_scan.RULES))
    one = "kind || ':' || CAST(first AS BIGINT) || ':' || CAST(first + size AS BIGINT)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({' UNION ALL '.join(parts)}),
sound AS (SELECT r, place, kind, m.first AS first, m.size AS size FROM hits WHERE m.counted >= CASE place {least} END),
per_doc AS (SELECT r, {counts},
    string_agg({one}, ',' ORDER BY first, place) FILTER (place < {len(secret_scan.BASE_RULES)}) AS base,
    string_agg({one}, ',' ORDER BY first, place, size) AS spans FROM sound GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{rule.kind}, 0) AS n_{rule.kind}' for rule in secret_scan.BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per_doc USING (r)
"""


DECONTAMINATE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS words
    FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
    FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size),
hits AS (SELECT r, i, p.size, item FROM places p JOIN windows USING (size, words)),
hit_words AS (SELECT r, count(DISTINCT n) AS n_hit FROM (SELECT DISTINCT r, i, size FROM hits), unnest(range(i, i + size)) AS t(n) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS words FROM d, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
firsts AS (SELECT words, min(doc_id) AS least FROM places GROUP BY words),
gone AS (SELECT r, list(DISTINCT n) AS gone FROM (SELECT r, i FROM places JOIN firsts USING (words) WHERE doc_id > least),
         unnest(range(i, i + 50)) AS t(n) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
           list_transform(list_filter(range(1, len(w) + 1), lambda n: NOT list_contains(gone, n)), lambda n: w[n]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""

SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
asked AS (SELECT q, item_id, unnest(w) AS term FROM b),
places AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d),
cells AS (SELECT r, doc_id, n, term, count(*) AS tf FROM places WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM cells, totals GROUP BY term, docs),
scores AS (SELECT q, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
    FROM asked JOIN cells USING (term) JOIN weights USING (term), totals GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""


def _merkle_sql(levels: int = 8) -> str:
    """Trees level by level; up to 16 ** levels leaves a source, and as many sources."""
    table = ", ".join(str(_crc_step(n)) for n in range(16))
    half = f"xor(c >> 4, list_extract([{table}], CAST(xor(c, {{nibble}}) & 15 AS INT) + 1))"
    field = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    whole = " || ".join(field.format(name) for name in merkle.FIELDS[:-1])
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def climb(first: str, prefix: str) -> str:
        """Of nodes (tree, pos, digest): their digests, run by run, until one is left in each tree."""
        parts, below = [], first
        for n in range(levels):
            parts.append(f"""
{prefix}{n} AS MATERIALIZED (SELECT tree, pos, digest, count(*) OVER (PARTITION BY tree) AS size,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
    FROM {below})""")
            below = (f"(SELECT tree, pos // 16 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {prefix}{n} "
                     "WHERE size > 1 GROUP BY tree, pos // 16)")
        return ",".join(parts)

    def paths(prefix: str) -> str:
        """Each leaf's (before, behind) pairs from its level up."""
        steps = ", ".join(f"CASE WHEN {prefix}{n}.size > 1 THEN {{'b': {prefix}{n}.before, 'a': {prefix}{n}.behind}} END" for n in range(levels))
        joins = " ".join(f"LEFT JOIN {prefix}{n} ON {prefix}{n}.tree = {prefix}0.tree AND {prefix}{n}.pos = {prefix}0.pos // {16 ** n}"
                         for n in range(1, levels))
        return f"SELECT {prefix}0.tree, {prefix}0.pos, list_filter([{steps}], lambda s: s IS NOT NULL) AS steps FROM {prefix}0 {joins}"

    crc = (f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: "
           f"CAST(ascii(ch) AS BIGINT))), lambda c, v: {half.format(nibble='(v >> 4)').replace('xor(c >> 4', 'xor(@ >> 4').replace('xor(c, ', 'xor(@, ')})")
    crc = crc.replace("@", f"({half.format(nibble='v')})")
    return f"""
WITH d AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {whole} || {field.format('text')} AS plain,
    {whole} || {field.format(lowered)} AS lowered, coalesce(xor({crc}, 4294967295) % 5 = 0, false) AS hit FROM documents),
leaves AS MATERIALIZED (SELECT doc_id, tree, sha256(plain) AS digest, sha256(CASE WHEN hit THEN lowered ELSE plain END) AS seen,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, sha256(plain)) - 1 AS pos FROM d),
{climb('leaves', 's')},
subroots AS MATERIALIZED (SELECT tree AS source_tree, digest AS subroot, 't' AS tree, subroot AS digest, row_number() OVER (ORDER BY encode(source_tree)) - 1 AS pos
    FROM ({' UNION ALL '.join(f'SELECT tree, digest FROM s{n} WHERE size = 1' for n in range(levels))})),
{climb('subroots', 't')},
tops AS ({' UNION ALL '.join(f'SELECT digest AS root FROM t{n} WHERE size = 1' for n in range(levels))}),
inner_paths AS ({paths('s')}),
outer_paths AS ({paths('t')}),
proofs AS (SELECT l.doc_id, l.digest AS leaf, l.seen, r.subroot, tops.root, list_concat(i.steps, o.steps) AS steps
    FROM leaves l JOIN inner_paths i ON i.tree = l.tree AND i.pos = l.pos JOIN subroots r ON r.source_tree = l.tree
    JOIN outer_paths o ON o.pos = r.pos, tops),
folded AS (SELECT *, list_reduce(list_prepend({{'b': seen, 'a': ''}}, steps), lambda x, s: {{'b': sha256(s.b || x.b || s.a), 'a': ''}}).b AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.b || s.a), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""


def _crc_step(n: int) -> int:
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


ORACLES: dict[str, str] = {
    "op11_lexical_search": SEARCH_SQL,
    "op13_merkle_manifest": _merkle_sql(),
    "op4_secret_scan": _secret_sql(),
    "op5_decontaminate": DECONTAMINATE_SQL,
    "op6_substring_dedup": SUBSTRING_SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
