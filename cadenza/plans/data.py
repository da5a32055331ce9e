"""Sources, joins, samples, splits and counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import scores
from cadenza.operators import sampling as S
from cadenza.operators import turns as O
from cadenza.plans import turns as T
from cadenza.sources import adapters as A
from cadenza.sources import shards as H

# Language codes of source configurations.
CODES = {"english": "en", "french": "fr", "german": "de", "spanish": "es"}


def archive_join(spark, sf_dir):
    """Line items with their part, as segments meet archive members; those without one are dropped."""
    items = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    members = A.table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", "p_name")
    return items.join(members, items.l_partkey == members.p_partkey).select("l_orderkey", "l_linenumber", "p_name")


def missing_members(spark, sf_dir):
    items = A.table(spark, sf_dir, "lineitem")
    members = A.table(spark, sf_dir, "part").where("p_size > 10")
    return items.join(members, items.l_partkey == members.p_partkey, "left_anti").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def first_wins_index(spark, sf_dir):
    """The first archive that holds each member: suppliers as archives, parts as members."""
    items = A.table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_partkey").alias("member")).agg(F.min("l_suppkey").alias("archive"))


def split_50_25_25(spark, sf_dir):
    out = S.split(A.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", ["lang"])
    return out.select("doc_id", "lang", "split")


def split_whole(spark, sf_dir):
    return S.split(A.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").groupBy("split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def sampled_scan(spark, sf_dir):
    """A reproducible sample of 100 documents (the limit is the feature)."""
    return S.sampled(A.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100)


def last_shard(spark, sf_dir):
    files = A.table(spark, sf_dir, "part").select(F.concat_ws("-", F.lower(F.substring_index("p_type", " ", 1)), F.lower(F.substring_index("p_brand", "#", -1)), F.format_string("%08d", "p_partkey")).alias("name"))
    return S.last_file(files)


def last_shard_of_prefix(spark, sf_dir):
    """The same, of one kind's files."""
    files = A.table(spark, sf_dir, "part").select(F.concat_ws("-", F.lower(F.substring_index("p_type", " ", 1)), F.lower(F.substring_index("p_brand", "#", -1)), F.format_string("%08d", "p_partkey")).alias("name"))
    return S.last_file(files, prefix="standard-")


def exact_shards(spark, sf_dir):
    """What ``shards.write_shards`` writes to each shard: line items in two streams, 20,000 to a shard."""
    items = A.table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), "l_orderkey")
    out = H.sharded(items, "id", streams=2).groupBy(H.STREAM, H.NUMBER).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"), F.min("id").alias("first"), F.max("rank").alias("last_rank"))
    return out.withColumnsRenamed({H.STREAM: "stream", H.NUMBER: "shard"})


def language_counts(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))


def dataset_card(spark, sf_dir):
    """Counts per language and in total, for a card."""
    d = A.table(spark, sf_dir, "documents")
    return d.groupingSets([[], [d.lang]], d.lang).agg(F.grouping("lang").alias("g"), F.count("*").alias("rows"), F.sum("n_chars").alias("chars")).select(F.when(F.col("g") == 1, "total").otherwise(F.col("lang")).alias("lang"), "rows", "chars")


def set_union_languages(spark, sf_dir):
    d, c = A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "pages")
    code = F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]{2})/", 1)
    return d.select("lang").union(c.select(code.alias("lang"))).where("lang <> ''").distinct()


def config_codes(spark, sf_dir):
    """Configuration names to codes, the name itself where there is none."""
    table = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))
    name = F.when(F.col("lang") == "en", "english").when(F.col("lang") == "fr", "french").otherwise(F.col("lang"))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(table[name], name).alias("code"))


def json_props(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def json_report(spark, sf_dir):
    """One JSON line per language."""
    c = language_counts(spark, sf_dir)
    return c.select(F.to_json(F.struct("lang", "n")).alias("line"))


def messages_column(spark, sf_dir):
    """Conversations as ordered messages: size, first role, and all contents."""
    m = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return m.select("conv_id", F.size("m").cast("long").alias("n"), F.col("m")[0]["role"].alias("first_role"), F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("content"))


def positional_zip(spark, sf_dir):
    """Words of neighbouring turns zipped up to the shorter one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("a"), F.split(F.lead("text").over(w), " ").alias("b")).where("b IS NOT NULL")
    z = F.slice(F.arrays_zip("a", "b"), 1, F.least(F.size("a"), F.size("b")))
    return c.select("conv_id", "turn", F.size(z).cast("long").alias("n"), F.element_at(z, -1)["a"].alias("last_a"), F.element_at(z, -1)["b"].alias("last_b"))


def turn_replay(spark, sf_dir):
    """Decisions of a policy over the gaps of each recording."""
    g = O.gaps(A.event_words(A.table(spark, sf_dir, "events"))).select("rec", "pos", (F.col("gap") / 3.6e9).alias("hours"))
    return g.select("rec", "pos", scores.decide(scores.heuristic(F.col("hours") / 10), F.col("hours"), 0.5, 2.0, 24.0).alias("status"))


def shard_sizing(spark, sf_dir):
    n = A.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    s = S.shard_sizes(F.col("n"), F.lit(8), F.col("n") % 11)
    return n.select("o_orderpriority", s["shards"].alias("shards"), s["per_shard"].cast("long").alias("per_shard"))


QUERIES = {f.__name__: f for f in (archive_join, missing_members, first_wins_index, split_50_25_25, split_whole, sampled_scan, last_shard, last_shard_of_prefix, exact_shards, language_counts, dataset_card, set_union_languages, config_codes, json_props, json_report, messages_column, positional_zip, turn_replay, shard_sizing)}


def split_sql(table: str, key: str, by: str) -> str:
    p = f"PARTITION BY {by} " if by else ""
    return f"""k AS (SELECT *, row_number() OVER ({p}ORDER BY sha256({key} || ':42'), {key}) - 1 AS k, count(*) OVER ({p}) AS n FROM {table}),
s AS (SELECT *, CASE WHEN k < n // 2 THEN 'train' WHEN k < n // 2 + n // 4 THEN 'validation' ELSE 'test' END AS split FROM k)"""

SQL = {
    "archive_join": "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10",
    "missing_members": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10) GROUP BY l_returnflag",
    "first_wins_index": "SELECT l_partkey AS member, min(l_suppkey) AS archive FROM lineitem GROUP BY l_partkey",
    "split_50_25_25": f"WITH {split_sql('documents', 'doc_id', 'lang')} SELECT doc_id, lang, split FROM s",
    "split_whole": f"WITH {split_sql('orders', 'o_orderkey', '')} SELECT split, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM s GROUP BY split",
    "sampled_scan": "SELECT doc_id, lang FROM documents ORDER BY sha256(doc_id || ':42'), doc_id LIMIT 100",
    "last_shard_of_prefix": """WITH f AS (SELECT lower(split_part(p_type, ' ', 1)) AS a, lower(split_part(p_brand, '#', -1)) AS b, lpad(p_partkey::VARCHAR, 8, '0') AS c FROM part)
SELECT a || '-' || b AS key, max(a || '-' || b || '-' || c) AS last FROM f WHERE starts_with(a, 'standard') GROUP BY a, b""",
    "exact_shards": """WITH f AS (SELECT l_orderkey, l_orderkey || ':' || l_linenumber AS id FROM lineitem),
h AS (SELECT *, sha256(id || ':42') AS h FROM f),
s AS (SELECT *, ('0x' || right(h, 4))::INT % 2 AS stream FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY h, id) - 1 AS rank FROM s)
SELECT stream, (rank // 20000)::INT AS shard, count(*) AS n, sum(l_orderkey)::BIGINT AS keys, min(id) AS first, max(rank) AS last_rank FROM r GROUP BY stream, rank // 20000""",
    "last_shard": """WITH f AS (SELECT lower(split_part(p_type, ' ', 1)) AS a, lower(split_part(p_brand, '#', -1)) AS b, lpad(p_partkey::VARCHAR, 8, '0') AS c FROM part)
SELECT a || '-' || b AS key, max(a || '-' || b || '-' || c) AS last FROM f GROUP BY a, b""",
    "language_counts": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "dataset_card": "SELECT lang, count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang UNION ALL SELECT 'total', count(*), sum(n_chars)::BIGINT FROM documents",
    "set_union_languages": "SELECT lang FROM documents UNION SELECT regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) FROM pages WHERE regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) <> ''",
    "config_codes": "SELECT doc_id, CASE lang WHEN 'english' THEN 'en' ELSE lang END AS code FROM documents",
    "json_props": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "json_report": """SELECT '{"lang":"' || lang || '","n":' || count(*) || '}' AS line FROM documents GROUP BY lang""",
    "messages_column": "SELECT conv_id, count(*) AS n, arg_min(role, turn) AS first_role, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id",
    "positional_zip": """WITH c AS (SELECT conv_id, turn, string_split(text, ' ') AS a, string_split(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ' ') AS b FROM conversations)
SELECT conv_id, turn, least(len(a), len(b)) AS n, a[least(len(a), len(b))] AS last_a, b[least(len(a), len(b))] AS last_b FROM c WHERE b IS NOT NULL""",
    "turn_replay": f"""WITH {T.EVENT_SQL}, {T.GAPS_SQL}, h AS (SELECT rec, pos, greatest(gap, 0) / 3600000000.0::DOUBLE AS h FROM near WHERE gap IS NOT NULL)
SELECT rec, pos, CASE WHEN h <= 0 THEN 'listening' WHEN h >= 24 THEN 'end_of_turn (timeout)' WHEN h >= 2 AND 1 - exp(-(h / 10) / 0.6::DOUBLE) >= 0.5 THEN 'end_of_turn' ELSE 'holding' END AS status FROM h""",
    "shard_sizing": """WITH n AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT *, greatest(least(8, n % 11), 1) AS shards FROM n)
SELECT o_orderpriority, shards, ceil(n / shards)::BIGINT AS per_shard FROM s""",
}
