"""The registered queries of the snapshot engine and their SQL.

Each query takes (spark, folder of tables) and returns a DataFrame; ORACLE_SQL has what a plain SQL engine says on the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataforge.functions import numbers as N
from strataforge.functions.grams import gram_count
from strataforge.operators import buckets, dictionary, lookup, trigrams
from strataforge.plans import fields as K
from strataforge.plans.generate import rename_candidates
from strataforge.plans.migrate import Migration
from strataforge.plans.schema import Schema, diff_manifests
from strataforge.sources import snapshot as S
from strataforge.sources.work import work_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its own name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


# --- numbers


@query("SELECT p_partkey, CAST(trunc(p_retailprice) AS INTEGER) AS as_u16, CAST(trunc(-p_retailprice / 7) AS SMALLINT) AS as_i16, CAST(p_retailprice AS FLOAT)::DOUBLE AS as_f32 FROM part")
def num_column_cast(spark, d):
    p = table(spark, d, "part")
    price = F.col("p_retailprice")
    return p.select("p_partkey", N.stored(price, "u16", "as_u16").alias("as_u16"), N.stored(-price / 7, "i16", "as_i16").alias("as_i16"), N.stored(price, "f32").cast("double").alias("as_f32"))


@query(
    "SELECT t AS type_name, CAST(count(*) FILTER (WHERE v < lo OR v > hi) AS BIGINT) AS n_bad FROM (SELECT p_retailprice AS v FROM part UNION ALL SELECT l_quantity - 10 FROM lineitem)"
    " CROSS JOIN (VALUES ('i8', -128, 127), ('u8', 0, 255), ('i16', -32768, 32767), ('u16', 0, 65535)) r(t, lo, hi) GROUP BY t"
)
def num_range_violations(spark, d):
    v = table(spark, d, "part").select(F.col("p_retailprice").alias("v")).unionByName(table(spark, d, "lineitem").select((F.col("l_quantity") - 10).alias("v")))
    kinds = ("i8", "u8", "i16", "u16")
    sums = v.agg(*(F.count_if(N.out_of_range(F.col("v"), k)).alias(k) for k in kinds))
    return sums.unpivot([], list(kinds), "type_name", "n_bad")


@query("SELECT l_discount, CAST(round_even(l_discount * 255, 0) AS SMALLINT) AS stored, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def clamped_column(spark, d):
    return table(spark, d, "lineitem").select("l_discount", N.stored(F.col("l_discount") * 255, "u8c").alias("stored")).groupBy("l_discount", "stored").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN CAST(p_size AS BIGINT) WHEN 1 THEN p_partkey ELSE 0 END AS value FROM part CROSS JOIN range(0, 3) r(pos)")
def stride_pad(spark, d):
    short = F.array(F.col("p_size").cast("long"), F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(N.fitted(short, 3)).alias("pos", "value"))


@query("SELECT p_partkey, p_size AS first_value, CAST(1 AS INTEGER) AS size FROM part")
def stride_trim(spark, d):
    long = F.array("p_size", F.lit(5), F.lit(6))
    return table(spark, d, "part").select("p_partkey", N.fitted(long, 1).alias("v")).select("p_partkey", F.get("v", F.lit(0)).alias("first_value"), F.size("v").alias("size"))


@query("SELECT p_partkey, (p_partkey - 100) % 4294967296 + CASE WHEN p_partkey < 100 THEN 4294967296 ELSE 0 END AS wrapped FROM part")
def u32_wrap(spark, d):
    return table(spark, d, "part").select("p_partkey", N.wrapped_u32(F.col("p_partkey") - 100).alias("wrapped"))


# --- single values and bytes, through a snapshot

_SINGLE = {"strings": K.string_table(), "last_region": K.single_string_ref(), "blob": K.raw_bytes()}


@query("SELECT arg_max(r_name, r_regionkey) AS value FROM region")
def single_string(spark, d):
    last = table(spark, d, "region").agg(F.max_by("r_name", "r_regionkey").alias("value"))
    built = S.builder(spark, Schema(_SINGLE)).put("last_region", last).put("blob", b"\x01\x02\x03").commit(work_path(spark, "single"))
    return built.get("last_region")


@query("SELECT CAST(octet_length(encode(n_name)) AS BIGINT) AS n_bytes, hex(encode(n_name)) AS content FROM nation WHERE n_nationkey = 3")
def raw_bytes_length(spark, d):
    value = table(spark, d, "nation").filter("n_nationkey = 3").select(F.col("n_name").cast("binary").alias("value"))
    schema = Schema({"strings": K.string_table(), "blob": K.raw_bytes()})
    blob = S.builder(spark, schema).put("blob", value).commit(work_path(spark, "blob")).get("blob")
    return blob.select(F.octet_length("value").cast("long").alias("n_bytes"), F.hex("value").alias("content"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS a, CAST(s_nationkey AS BIGINT) AS b, CAST(s_suppkey % 100 AS BIGINT) AS x FROM supplier")
def legacy_pair_index(spark, d):
    s = table(spark, d, "supplier")
    rows_ = s.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("b"), F.struct((F.col("s_suppkey") % 100).alias("x")).alias("item"), F.col("s_suppkey").alias("seq"))
    schema = Schema({"strings": K.string_table(), "pairs": K.field_from_signature("pairIndex:x=Uint32Array:1")})
    pairs = S.builder(spark, schema).put("pairs", rows_).commit(work_path(spark, "legacy")).get("pairs")
    found = lookup.find_pair(s.select(F.col("s_suppkey").cast("long").alias("a"), F.col("s_nationkey").cast("long").alias("b")), pairs)
    return found.select("a", "b", F.col("item.x").cast("long").alias("x"))


@query("SELECT CAST(p_partkey AS BIGINT) AS idx, p_retailprice AS value FROM part")
def untyped_read(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("value"))
    path = S.builder(spark, Schema({"strings": K.string_table(), "price": K.num_array("f64")})).put("price", p).commit(work_path(spark, "untyped")).path
    return S.Snapshot(spark, path).get("price").select("idx", "value")


@query("SELECT p_partkey AS idx, p_retailprice AS price, p_name AS name FROM part")
def entity_view(spark, d):
    p = table(spark, d, "part")
    schema = Schema({"strings": K.string_table(), "price": K.num_array("f64"), "name": K.string_ref_array()})
    writer = S.builder(spark, schema).put("price", p.select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("value")))
    return writer.put("name", p.select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("value"))).commit(work_path(spark, "entities")).entity_view("price", "name")


# --- dictionary


def _names(spark, d) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("value"), F.struct(F.lit(0).alias("f"), F.col("c_custkey").alias("i")).alias("seq"))
    n = table(spark, d, "nation").select(F.col("n_name").alias("value"), F.struct(F.lit(1).alias("f"), F.col("n_nationkey").cast("long").alias("i")).alias("seq"))
    return c.unionByName(n)


_INTERN = (
    "SELECT CAST(0 AS BIGINT) AS id, '' AS value UNION ALL SELECT CAST(row_number() OVER (ORDER BY seq) AS BIGINT), value FROM"
    " (SELECT value, min(seq) AS seq FROM (SELECT c_mktsegment AS value, c_custkey AS seq FROM customer UNION ALL SELECT n_name, 1000000000 + n_nationkey FROM nation) GROUP BY value)"
)


@query(_INTERN)
def string_intern(spark, d):
    return dictionary.intern(_names(spark, d))


@query(f"WITH dict AS ({_INTERN}) SELECT r.i AS id, coalesce(dict.value, '') AS value FROM range(0, 40) r(i) LEFT JOIN dict ON dict.id = r.i")
def string_resolve(spark, d):
    return dictionary.resolve(spark.range(40), dictionary.intern(_names(spark, d)))


@query(f"WITH dict AS ({_INTERN}) SELECT n_name || s AS value, coalesce(dict.id, -1) AS id FROM nation CROSS JOIN (VALUES (''), ('?')) x(s) LEFT JOIN dict ON dict.value = n_name || s UNION ALL SELECT '', 0")
def string_id_of(spark, d):
    asked = table(spark, d, "nation").select(F.explode(F.array("n_name", F.concat("n_name", F.lit("?")))).alias("value")).unionByName(rows(spark, [("",)], "value string"))
    return dictionary.id_of(asked, dictionary.intern(_names(spark, d)))


@query(f"WITH dict AS ({_INTERN}) SELECT id, value = 'BUILDING' AS same FROM dict")
def string_equals(spark, d):
    words = dictionary.intern(_names(spark, d))
    return dictionary.same_as(words.select("id"), words, "BUILDING")


@query(
    f"WITH dict AS ({_INTERN}), fresh AS (SELECT s_name AS value, min(s_suppkey) AS seq FROM supplier WHERE s_name NOT IN (SELECT value FROM dict) GROUP BY 1)"
    " SELECT id, value FROM dict UNION ALL SELECT CAST((SELECT max(id) FROM dict) + row_number() OVER (ORDER BY seq) AS BIGINT), value FROM fresh"
)
def dictionary_append(spark, d):
    both = table(spark, d, "supplier").select(F.col("s_name").alias("value"), F.col("s_suppkey").alias("seq")).unionByName(table(spark, d, "nation").select(F.col("n_name").alias("value"), F.lit(0).cast("long").alias("seq")))
    return dictionary.append(dictionary.intern(_names(spark, d)), both)


# --- lookups


def _asked(spark, d) -> DataFrame:
    """Names of some customers, each also misspelled."""
    return table(spark, d, "customer").select(F.explode(F.array("c_name", F.concat("c_name", F.lit("x")))).alias("key"))


_ASKED = "(SELECT c_name || s AS key FROM customer CROSS JOIN (VALUES (''), ('x')) v(s))"


def _customer_index(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("value"), F.col("c_custkey").alias("seq"))


@query(f"SELECT key, c_custkey AS value FROM {_ASKED} LEFT JOIN customer ON c_name = key")
def hash_lookup_find(spark, d):
    return lookup.find(_asked(spark, d), _customer_index(spark, d))


@query(f"SELECT key, idx, CASE WHEN idx IS NOT NULL THEN c_acctbal END AS balance FROM (SELECT key, c_custkey AS idx, c_acctbal FROM {_ASKED} LEFT JOIN customer ON c_name = key)")
def lookup_customer_balance(spark, d):
    """Build a snapshot of customers, open it again, find keys by name (verified) and read a column of what was found."""
    c = table(spark, d, "customer")
    schema = Schema({"strings": K.string_table(), "name": K.string_ref_array(), "by_name": K.hash_lookup("name"), "balance": K.num_array("f64")})
    path = work_path(spark, "customers")
    writer = S.builder(spark, schema).put("name", c.select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("value")))
    writer.put("by_name", _customer_index(spark, d)).put("balance", c.select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("value"))).commit(path)
    opened = S.read(spark, schema, path)
    found = lookup.find_verified(_asked(spark, d), opened.get("by_name"), opened.get("name"), value="idx")
    return found.join(opened.get("balance").withColumnRenamed("value", "balance"), "idx", "left").select("key", "idx", "balance")


def _part_index(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("value"), F.col("p_partkey").alias("seq"))


@query("SELECT p_name AS key, min(p_partkey) AS value FROM part GROUP BY 1")
def hash_lookup_first_wins(spark, d):
    return lookup.find(table(spark, d, "part").select(F.col("p_name").alias("key")).distinct(), _part_index(spark, d))


@query(
    "WITH ix AS (SELECT p_name AS key, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS value, p_partkey AS seq FROM part), ok AS (SELECT ix.key, arg_min(ix.value, seq) AS value FROM ix JOIN part ON part.p_partkey = ix.value AND part.p_name = ix.key GROUP BY 1)"
    " SELECT k.key, ok.value FROM (SELECT DISTINCT p_name AS key FROM part) k LEFT JOIN ok USING (key)"
)
def hash_lookup_verified(spark, d):
    """An index whose first rows often point at other names: the first row that holds wins."""
    p = table(spark, d, "part")
    n = p.count()
    index = p.select(F.col("p_name").alias("key"), F.pmod(F.col("p_partkey") * 7 + 3, F.lit(n)).alias("value"), F.col("p_partkey").alias("seq"))
    names = p.select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("value"))
    return lookup.find_verified(p.select(F.col("p_name").alias("key")).distinct(), index, names)


_HASHED = "(SELECT p_partkey % 50 AS hash, p_partkey AS value, p_partkey AS seq FROM part)"


@query(f"WITH ix AS (SELECT CASE hash WHEN 0 THEN 1 ELSE hash END AS h, min(value) AS value FROM {_HASHED} GROUP BY 1) SELECT r.i AS hash, ix.value FROM range(0, 60) r(i) LEFT JOIN ix ON ix.h = CASE r.i WHEN 0 THEN 1 ELSE r.i END")
def hash_lookup_raw(spark, d):
    index = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("hash"), F.col("p_partkey").alias("value"), F.col("p_partkey").alias("seq"))
    return lookup.find_raw(spark.range(60).withColumnRenamed("id", "hash"), index)


@query(f"WITH ix AS (SELECT CASE hash WHEN 0 THEN 1 ELSE hash END AS h, min(value) AS value FROM {_HASHED} GROUP BY 1) SELECT r.i AS lo, CAST(0 AS BIGINT) AS hi, ix.value FROM range(0, 60) r(i) LEFT JOIN ix ON ix.h = CASE r.i WHEN 0 THEN 1 ELSE r.i END")
def hash_lookup_split(spark, d):
    index = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("hash"), F.col("p_partkey").alias("value"), F.col("p_partkey").alias("seq"))
    return lookup.find_split(spark.range(60).select(F.col("id").alias("lo"), F.lit(0).cast("long").alias("hi")), index).select("lo", "hi", "value")


@query("SELECT o_orderkey AS key FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def hash_semi(spark, d):
    return lookup.hits(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")))


@query("SELECT o_orderkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def hash_anti(spark, d):
    return lookup.misses(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")))


@query(
    "WITH own AS (SELECT c_mktsegment AS key, c_nationkey AS n, c_custkey FROM customer), first AS (SELECT key, arg_min(n, c_custkey) AS n FROM own GROUP BY 1)"
    " SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY c_custkey) - 1 AS INTEGER) AS pos, c_custkey AS item FROM own JOIN first USING (key, n) UNION ALL SELECT 'NO SUCH', NULL, NULL"
)
def keyed_index(spark, d):
    """Lists of customers by segment and nation; of a segment's several lists the first inserted is found."""
    c = table(spark, d, "customer")
    lists = c.groupBy("c_mktsegment", "c_nationkey").agg(F.sort_array(F.collect_list("c_custkey")).alias("items"), F.min("c_custkey").alias("seq")).withColumnRenamed("c_mktsegment", "key")
    asked = c.select(F.col("c_mktsegment").alias("key")).distinct().unionByName(rows(spark, [("NO SUCH",)], "key string"))
    return lookup.find_list(asked, lists.drop("c_nationkey")).select("key", F.posexplode_outer("items").alias("pos", "item"))


def _line_pairs(spark, d) -> DataFrame:
    order = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("long").alias("b"), F.struct("l_partkey", "l_suppkey").alias("item"), order.alias("seq"))


@query("SELECT l_orderkey AS a, CAST(l_linenumber AS BIGINT) AS b, min(struct_pack(p := l_partkey, s := l_suppkey)).p AS l_partkey, min(struct_pack(p := l_partkey, s := l_suppkey)).s AS l_suppkey FROM lineitem GROUP BY 1, 2")
def pair_index(spark, d):
    index = _line_pairs(spark, d)
    return lookup.find_pair(index.select("a", "b").distinct(), index).select("a", "b", "item.*")


@query(
    "WITH ix AS (SELECT l_orderkey AS a, CAST(l_linenumber AS BIGINT) AS b, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), asked AS (SELECT DISTINCT b AS a, a AS b FROM ix)"
    " SELECT asked.a, asked.b, ix.p AS l_partkey FROM asked LEFT JOIN ix ON ix.a = asked.a AND ix.b = asked.b"
)
def pair_index_ordered(spark, d):
    """Swapped pairs are other pairs."""
    index = _line_pairs(spark, d)
    return lookup.find_pair(index.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct(), index).select("a", "b", F.col("item.l_partkey").alias("l_partkey"))


@query("SELECT l_orderkey - 4294967296 AS a, CAST(l_linenumber AS BIGINT) AS b, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def pair_index_wraps(spark, d):
    """Components are taken modulo 2^32 on both sides."""
    index = _line_pairs(spark, d)
    return lookup.find_pair(index.select((F.col("a") - 2**32).alias("a"), "b").distinct(), index).select("a", "b", F.col("item.l_partkey").alias("l_partkey"))


@query("SELECT r.i AS key, v.o AS value FROM range(-5, 1000) r(i) LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY 1) v ON v.o_custkey = r.i")
def sorted_u32_find(spark, d):
    index = lookup.build_sorted(table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("seq")))
    return lookup.find_sorted(spark.range(-5, 1000).withColumnRenamed("id", "key"), index)


@query("SELECT o_custkey AS key, o_orderkey AS seq, CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS BIGINT) AS place FROM orders")
def radix_sort(spark, d):
    """The stable order of u32 keys, as dense places."""
    return dictionary.numbered(table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq")), ["key", "seq"], "place")


# --- buckets


def _order_lines(spark, d) -> DataFrame:
    """Part numbers of each order's lines; orders without lines have empty buckets."""
    at = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("idx"), F.row_number().over(at).alias("pos"), "l_partkey")
    return buckets.build(lines, ["l_partkey"], table(spark, d, "orders").select(F.col("o_orderkey").alias("idx")))


_LINES = "(SELECT l_orderkey AS idx, l_partkey AS item, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS pos FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"
_SIZES = f"(SELECT o_orderkey AS idx, CAST(coalesce(n, 0) AS BIGINT) AS n FROM orders LEFT JOIN (SELECT idx, count(*) AS n FROM {_LINES} GROUP BY 1) ON idx = o_orderkey)"


@query("SELECT CAST(count(*) AS BIGINT) AS bucket_count FROM orders")
def bucket_count(spark, d):
    return buckets.bucket_count(_order_lines(spark, d))


@query(f"SELECT idx, n AS length FROM {_SIZES}")
def bucket_length(spark, d):
    return buckets.lengths(_order_lines(spark, d))


@query(f"SELECT idx, CAST(sum(n) OVER (ORDER BY idx) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY idx) AS BIGINT) AS stop FROM {_SIZES}")
def bucket_range(spark, d):
    return buckets.ranges(_order_lines(spark, d))


@query(f"SELECT pos, item FROM {_LINES} WHERE idx = 7")
def bucket_slice(spark, d):
    return buckets.slice_of(_order_lines(spark, d), 7).select(F.posexplode("items").alias("pos", "item"))


@query(f"SELECT o_orderkey AS idx, item FROM orders LEFT JOIN {_LINES} ON idx = o_orderkey AND pos = 1")
def bucket_get(spark, d):
    return buckets.get(_order_lines(spark, d), "idx", 1)


@query(f"SELECT idx, pos, item FROM {_LINES}")
def bucket_items(spark, d):
    return buckets.exploded(_order_lines(spark, d))


@query("SELECT p_partkey AS idx, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN p_size WHEN 1 THEN 0 WHEN 2 THEN p_size + 1 ELSE 9 END AS item FROM part CROSS JOIN range(0, 4) r(pos)")
def bucket_stride_flat(spark, d):
    """Two strided items an entity, the first one short, as one flat list."""
    pairs = F.array(N.fitted(F.array("p_size"), 2), N.fitted(F.array(F.col("p_size") + 1, F.lit(9), F.lit(3)), 2))
    return buckets.exploded(buckets.flat_slice(table(spark, d, "part").select(F.col("p_partkey").alias("idx"), pairs.alias("items"))))


@query("SELECT conv_id AS idx, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, CAST(length(text) AS INTEGER) AS n FROM conversations")
def multi_bucket_get(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("idx"), F.col("turn").alias("pos"), "role", F.length("text").alias("n"))
    return buckets.exploded(buckets.build(turns, ["role", "n"])).select("idx", "pos", "item.*")


# --- trigrams


def _part_names(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))


_GRAMS = "list_transform(range(1, length(l) - 1), lambda i: substring(l, i, 3))"
_POSTINGS = f"SELECT DISTINCT id, unnest({_GRAMS}) AS gram FROM (SELECT p_partkey AS id, lower(p_name) AS l FROM part WHERE length(p_name) >= 3)"


@query(f"SELECT gram, id, id AS seq FROM ({_POSTINGS})")
def trigram_postings(spark, d):
    return trigrams.postings(_part_names(spark, d))


@query("SELECT p_partkey, CAST(length(p_name) - 2 AS INTEGER) AS grams FROM part")
def trigram_count(spark, d):
    return table(spark, d, "part").select("p_partkey", gram_count(F.col("p_name")).alias("grams"))


def _search_sql(asked: dict[str, str], ratio: float, limit: int | None = None) -> str:
    values = ", ".join(f"('{k}', '{v}')" for k, v in asked.items())
    return (
        f"WITH p AS ({_POSTINGS}), q AS (SELECT query, unnest(range(0, len(g))) AS t, unnest(g) AS gram, len(g) AS n FROM (SELECT query, CASE WHEN length(l) >= 3 THEN {_GRAMS} WHEN length(l) > 0 THEN [l] ELSE [] END AS g FROM (SELECT query, lower(text) AS l FROM (VALUES {values}) v(query, text)))),"
        " s AS (SELECT query, id, n, count(*) AS score, min(t) AS first_t FROM q JOIN p USING (gram) GROUP BY 1, 2, 3), b AS (SELECT *, max(score) OVER (PARTITION BY query) AS mx FROM s),"
        f" k AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, first_t, id) AS place FROM b WHERE score >= greatest(greatest(1, n - 1), mx * CAST({ratio} AS DOUBLE)))"
        f" SELECT query, CAST(place AS INTEGER) AS place, id, CAST(score AS BIGINT) AS score FROM k{f' WHERE place <= {limit}' if limit is not None else ''}"
    )


_ONE = {"a": "large anvil"}
_MANY = {"a": "Small Ring", "b": "widget", "c": "blue bolt!", "d": "gearge", "e": "zzz", "f": "ol"}


def _search(spark, d, asked: dict[str, str], ratio: float = trigrams.RATIO, limit: int | None = None) -> DataFrame:
    return trigrams.search(rows(spark, list(asked.items()), "query string, text string"), trigrams.postings(_part_names(spark, d)), ratio, limit)


@query(_search_sql(_ONE, 0.7))
def trigram_search(spark, d):
    return _search(spark, d, _ONE)


@query(_search_sql({"a": "ring"}, 1.0))
def trigram_ratio(spark, d):
    return _search(spark, d, {"a": "ring"}, ratio=1.0)


@query(_search_sql({"a": "bolt"}, 0.7, 5))
def trigram_limit(spark, d):
    return _search(spark, d, {"a": "bolt"}, limit=5)


@query("SELECT q.query, CAST(CASE q.query WHEN 'a' THEN 0 ELSE (SELECT count(*) FROM (" + _search_sql({"b": "ring"}, 0.7) + ")) END AS BIGINT) AS n_hits FROM (SELECT unnest(['a', 'b']) AS query) q")
def trigram_short(spark, d):
    """A text shorter than a trigram has no hits, whatever is searched beside it."""
    asked = {"a": "ol", "b": "ring"}
    found = _search(spark, d, asked).groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    return rows(spark, [(q,) for q in asked], "query string").join(found, "query", "left").select("query", F.coalesce("n", F.lit(0)).cast("long").alias("n_hits"))


@query(_search_sql(_MANY, 0.5))
def trigram_multi_query(spark, d):
    return _search(spark, d, _MANY, ratio=0.5)


# --- manifests

_OLD = {"strings": K.string_table(), "cityName": K.single_string_ref(), "byId": K.hash_lookup("id"), "id": K.string_ref_array(), "lat": K.num_array("i32"), "gone": K.num_array("u8")}
_NEW = {"strings": K.string_table(), "city": K.single_string_ref(), "id": K.string_ref_array(), "byId": K.hash_lookup("id"), "lat": K.num_array("f64"), "bearing": K.num_array("u16")}


def _manifest(fields: dict) -> list[tuple[str, str, int]]:
    return Schema(fields).compiled.manifest


def _values(fields: dict) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{n}', '{s}')" for i, (n, s, _) in enumerate(_manifest(fields))) + ")"


@query(
    f"SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.sig <> b.sig THEN 'changed' ELSE 'moved' END AS kind"
    f" FROM {_values(_OLD)} a(i, name, sig) FULL JOIN {_values(_NEW)} b(i, name, sig) ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.sig <> b.sig OR a.i <> b.i"
)
def manifest_diff(spark, d):
    return rows(spark, [(x.name, x.kind) for x in diff_manifests(_manifest(_OLD), _manifest(_NEW))], "name string, kind string")


@query(f"SELECT a.name AS removed, b.name AS added, a.sig AS signature FROM {_values(_OLD)} a(i, name, sig) JOIN {_values(_NEW)} b(i, name, sig) USING (sig) WHERE a.name NOT IN (SELECT name FROM {_values(_NEW)} x(i, name, sig)) AND b.name NOT IN (SELECT name FROM {_values(_OLD)} y(i, name, sig))")
def manifest_rename_candidates(spark, d):
    return rows(spark, rename_candidates(diff_manifests(_manifest(_OLD), _manifest(_NEW))), "removed string, added string, signature string")


@query("SELECT unnest(['name', 'price', 'strings']) AS name, true AS holds_bytes, true AS adds_up")
def inspect_bytes(spark, d):
    """Sizes are those of files, so only that every field has one and that the shares add up can be held against SQL."""
    snapshot = _parts_v0(spark, d)
    total = F.lit(float(snapshot.total_bytes))
    return S.inspect(spark, snapshot.path).select("name", (F.col("bytes") > 0).alias("holds_bytes"), (F.abs(F.col("share") - F.col("bytes") / total) < 1e-9).alias("adds_up"))


@query("SELECT 'name' AS name, CAST(count(*) AS BIGINT) AS n FROM part UNION ALL SELECT 'price', count(*) FROM part UNION ALL SELECT 'strings', count(DISTINCT p_name) + 1 FROM part")
def inspect_rows(spark, d):
    return S.inspect(spark, _parts_v0(spark, d).path).select("name", F.col("rows").alias("n"))


# --- migrations

_V0 = {"strings": K.string_table(), "name": K.string_ref_array(), "price": K.num_array("f64")}


def _parts_v0(spark, d):
    p = table(spark, d, "part")
    writer = S.builder(spark, Schema(_V0)).put("name", p.select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("value")))
    return writer.put("price", p.select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("value"))).commit(work_path(spark, "parts"))


def _migrated(spark, d, fields: dict, **step):
    old = _parts_v0(spark, d)
    schema = Schema(fields, 1, [Migration(start=0, end=1, id="0001_step", **step)])
    return S.open_snapshot(spark, schema, old.path)[0]


@query("SELECT p_partkey AS idx, CAST(trunc(p_retailprice * 100) AS INTEGER) AS value FROM part")
def migrate_retype(spark, d):
    cents = lambda c: {"price": c.previous.get("price").withColumn("value", F.col("value") * 100)}
    return _migrated(spark, d, {**_V0, "price": K.num_array("i32")}, defines=["price"], up=cents).get("price")


@query("SELECT p_partkey AS idx, p_name AS value FROM part")
def migrate_rename(spark, d):
    return _migrated(spark, d, {"strings": K.string_table(), "title": K.string_ref_array(), "price": K.num_array("f64")}, renames={"name": "title"}).get("title")


@query("SELECT p_partkey AS idx, CAST(length(p_name) AS INTEGER) AS value FROM part")
def migrate_add(spark, d):
    sizes = lambda c: {"size": c.previous.get("name").withColumn("value", F.length("value"))}
    return _migrated(spark, d, {**_V0, "size": K.num_array("u16")}, defines=["size"], up=sizes).get("size")


@query("SELECT n AS name FROM (VALUES ('strings'), ('name')) v(n)")
def migrate_drop(spark, d):
    kept = _migrated(spark, d, {"strings": K.string_table(), "name": K.string_ref_array()}, drops=["price"])
    return rows(spark, [(n,) for n in kept.names], "name string")


@query("SELECT p_partkey AS idx, round(p_retailprice / 2, 4) AS value FROM part")
def migrate_rebuild(spark, d):
    half = lambda c: {"price": c.previous.get("price").withColumn("value", F.round(F.col("value") / 2, 4))}
    return _migrated(spark, d, _V0, rebuilds=["price"], up=half).get("price")


@query("SELECT s_suppkey AS idx, s_name AS value, CAST(dense_rank() OVER (ORDER BY s_suppkey) AS BIGINT) AS id FROM supplier")
def string_ids_view(spark, d):
    """A string column with its dictionary ids."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("value"))
    return S.builder(spark, Schema({"strings": K.string_table(), "name": K.string_ref_array()})).put("name", s).commit(work_path(spark, "suppliers")).ids("name")
