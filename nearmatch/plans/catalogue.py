"""The query catalogue: every operator as a query over the test tables, with its SQL.

The media tables are stood in for by the test tables: embeddings are 8x8
coefficient blocks (of which hashes are packed), documents are videos
(n_chars as size, source as group), pages are files, events are frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearmatch import schemas, settings
from nearmatch.functions import hashing, media
from nearmatch.functions import phash as perceptual
from nearmatch.operators import actions, filters, groups, sampling, similarity
from nearmatch.operators.components import connected_components
from nearmatch.plans import search
from nearmatch.sources import files as scans
from nearmatch.sources import store
from nearmatch.sources.shared import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _hashes(spark: SparkSession, sf: str, videos: int | None = None) -> DataFrame:
    """video_id, h: the packed hash of each embedding; video_id is vec_id, modulo videos if given."""
    vid = F.col("vec_id") % videos if videos else F.col("vec_id")
    return _t(spark, sf, "embeddings").select(vid.cast("long").alias("video_id"), hashing.pack_bits(F.col("embedding")).alias("h"))


def _ids(hashes: DataFrame) -> DataFrame:
    return hashes.select(F.col("video_id").alias("id")).distinct()


# What the SQL of the hash queries begins with: vec_id and h, the packed hash without bit 0.
_H = """
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
m AS (SELECT vec_id, v, (list_sort(v)[32] + list_sort(v)[33]) / 2 AS med FROM e),
hs AS (SELECT vec_id, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN v[i + 1] > med THEN (1::BIGINT << (63 - i)::BIGINT) ELSE 0::BIGINT END))::BIGINT AS h63 FROM m)
"""


def _pairs_sql(videos: int | None, radius: int) -> str:
    vid = f"vec_id % {videos}" if videos else "vec_id"
    return f"""{_H}, u AS (SELECT {vid} AS video_id, h63, vec_id FROM hs WHERE h63 <> 0),
p AS (SELECT a.video_id AS src, b.video_id AS dst, a.h63 AS ha, b.h63 AS hb FROM u a JOIN u b ON a.video_id < b.video_id AND bit_count(xor(a.h63, b.h63)) <= {radius}),
c AS (SELECT src, dst, count(*) AS matches FROM p GROUP BY src, dst),
n AS (SELECT video_id, count(*) AS n FROM u GROUP BY video_id)"""


def _components_sql(edges: str, ids: str) -> str:
    """r(id, root) over edges(src, dst) and ids(id)."""
    return f"""b AS (SELECT src AS a, dst AS z FROM {edges} UNION SELECT dst, src FROM {edges}),
w(id, reach) AS (SELECT id, id FROM {ids} UNION SELECT w.id, b.z FROM w JOIN b ON w.reach = b.a),
r AS (SELECT id, min(reach) AS root FROM w GROUP BY id)"""


# Hashes.


@query(f"WITH {_H} SELECT vec_id, h63 FROM hs")
def phash_pack_bits(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", hashing.h63(hashing.pack_bits(F.col("embedding"))).alias("h63"))


@query(f"WITH {_H} SELECT vec_id, lower(printf('%015x', h63 >> 3) || printf('%x', (h63 & 7) * 2)) AS hex FROM hs")
def hash_hex(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", hashing.hash_hex(hashing.pack_bits(F.col("embedding"))).alias("hex"))


@query(f"WITH {_H}, x AS (SELECT vec_id, h63 FROM hs UNION ALL SELECT vec_id, 0 FROM hs WHERE vec_id % 3 = 0) SELECT vec_id, h63 FROM x WHERE h63 <> 0 AND h63 <> (1::BIGINT << 62)")
def degenerate_hash_filter(spark, sf):
    h = _hashes(spark, sf)
    both = h.unionByName(h.where("video_id % 3 = 0").withColumn("h", F.lit(0).cast("long"))).unionByName(h.where("video_id % 5 = 0").withColumn("h", F.lit(None).cast("long")))
    return both.where(hashing.usable(F.col("h"), sign_bit=True)).select(F.col("video_id").alias("vec_id"), hashing.h63(F.col("h")).alias("h63"))


@query(f"WITH {_H} SELECT vec_id % 100 AS video_id, count(*)::BIGINT AS n, sum(h63 % 1000003)::BIGINT AS checksum FROM hs GROUP BY 1")
def hash_blob_roundtrip(spark, sf):
    arrays = _hashes(spark, sf, 100).groupBy("video_id").agg(F.collect_list("h").alias("hashes"))
    blobs = arrays.select("video_id", F.concat(hashing.encode_blob(F.col("hashes")), F.unhex(F.lit("0102"))).alias("hash_blob"))
    h = store.decode_hashes(blobs).select("video_id", F.explode("hashes").alias("h"))
    return h.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.sum(hashing.h63(F.col("h")) % 1000003).alias("checksum"))


def _tile_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tiles are made and hashed 256 at a time, 8 kB each: no batch of them leaves the task."""
    x, y = np.meshgrid(np.arange(perceptual.N), np.arange(perceptual.N))
    for pdf in batches:
        for begin in range(0, len(pdf), 256):
            some = pdf.iloc[begin : begin + 256]
            e = np.stack(some["embedding"].tolist()).astype(np.float64)
            tiles = (e[:, y] * e[:, x + 32] + e[:, x * y % 64]).reshape(len(some), -1)
            yield pd.DataFrame({"vec_id": some["vec_id"], "h": [perceptual.hash_tile(t) for t in tiles]})


# What a pixel adds to a coefficient, through the box sum and the transform: w(k, y). Then tiles by rows, and by columns.
@query("""
WITH r AS (SELECT k, y, sqrt(2 / 32::DOUBLE) * cos(pi() / 64 * k * (2 * y + 1)) AS c FROM range(1, 9) a(k), range(32) b(y)),
w AS (SELECT k, greatest(0, least(31, y + d)) AS y, sum(c) AS c FROM r, range(-3, 4) b(d) GROUP BY 1, 2),
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
t AS (SELECT vec_id, y, x, v[y + 1] * v[x + 33] + v[x * y % 64 + 1] AS t FROM e, range(32) a(y), range(32) b(x)),
a AS (SELECT vec_id, k, x, sum(w.c * t) AS t FROM t JOIN w ON w.y = t.y GROUP BY vec_id, k, x),
c AS (SELECT vec_id, a.k, w.k AS l, sum(w.c * t) AS c FROM a JOIN w ON w.y = a.x GROUP BY vec_id, a.k, w.k),
l AS (SELECT vec_id, list(c ORDER BY k, l) AS c, list_sort(list(c)) AS s FROM c GROUP BY vec_id)
SELECT vec_id, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN c[i + 1] > (s[32] + s[33]) / 2 THEN (1::BIGINT << (63 - i)::BIGINT) ELSE 0::BIGINT END))::BIGINT AS h63 FROM l
""")
def phash_tile_numpy(spark, sf):
    """A 32x32 tile of each embedding, from products of its parts, hashed by the image kernel."""
    hashes = _t(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(_tile_hashes, "vec_id long, h long")
    return hashes.select("vec_id", hashing.h63(F.col("h")).alias("h63"))


# The similarity join, counts, edges and groups.


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("a_video_id").alias("src"), F.col("b_video_id").alias("dst"), hashing.h63(F.col("a_h")).alias("ha"), hashing.h63(F.col("b_h")).alias("hb"))


@query(f"WITH {_pairs_sql(None, 18)} SELECT src, dst, ha, hb FROM p")
def hamming_pairs_brute(spark, sf):
    return _pairs(similarity.hamming_pairs_brute(_hashes(spark, sf), 18))


@query(f"WITH {_pairs_sql(None, 18)} SELECT src, dst, ha, hb FROM p")
def hamming_pairs_banded(spark, sf):
    return _pairs(similarity.hamming_pairs_banded(_hashes(spark, sf), 18))


@query(f"""
WITH {_H}, n AS (SELECT vec_id + 1000000 AS video_id, xor(h63, (((1::BIGINT << (vec_id // 5 % 7)::BIGINT) - 1) << (vec_id % 50)::BIGINT)) AS h63 FROM hs WHERE vec_id % 5 = 0),
u AS (SELECT vec_id AS video_id, h63 FROM hs WHERE h63 <> 0 UNION ALL SELECT video_id, h63 FROM n WHERE h63 <> 0)
SELECT a.video_id AS src, b.video_id AS dst, a.h63 AS ha, b.h63 AS hb FROM u a JOIN u b ON a.video_id < b.video_id AND bit_count(xor(a.h63, b.h63)) <= 4
""")
def hamming_pairs_default_radius(spark, sf):
    """At the radius that searches take: every fifth hash has one beside it of which 0 to 6 bits in a row are others."""
    h, v = _hashes(spark, sf), F.col("video_id")
    run = F.call_function("shiftleft", F.lit(1).cast("long"), (F.floor(v / 5) % 7).cast("int")) - 1
    near = h.where(v % 5 == 0).select((v + 1_000_000).alias("video_id"), F.col("h").bitwiseXOR(F.call_function("shiftleft", run, (v % 50 + 1).cast("int"))).alias("h"))
    return _pairs(similarity.hamming_pairs(h.unionByName(near), 4))


@query("""
WITH u AS (SELECT doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS h FROM documents),
k AS (SELECT h, count(*) AS copies, min(doc_id) AS first_id FROM u GROUP BY h HAVING count(*) > 1)
SELECT u.doc_id, k.first_id, k.copies FROM u JOIN k ON u.h = k.h
""")
def hamming_equal_join(spark, sf):
    """Radius 0: equal hashes, as groups and not as all their pairs."""
    h = _t(spark, sf, "documents").select("doc_id", F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("h"))
    k = h.groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")
    return h.join(k, "h").select("doc_id", "first_id", "copies")


@query(f"WITH {_pairs_sql(250, 18)} SELECT video_id, n FROM n")
def hash_count_per_group(spark, sf):
    return similarity.hash_counts(_hashes(spark, sf, 250))


@query(f"WITH {_pairs_sql(100, 22)} SELECT src, dst, matches FROM c")
def match_counts(spark, sf):
    return similarity.hamming_matches(_hashes(spark, sf, 100), 22)


@query(f"WITH {_pairs_sql(100, 22)} SELECT src, dst, matches FROM c WHERE matches >= 2")
def edges_fixed_threshold(spark, sf):
    h = materialize(_hashes(spark, sf, 100), "hashes")
    return similarity.edges(similarity.hamming_matches(h, 22), h, number=2)


_PERCENT = f"""{_pairs_sql(125, 22)}, ed AS (SELECT src, dst, matches FROM c JOIN n x ON x.video_id = src JOIN n y ON y.video_id = dst
WHERE matches >= ceil(greatest(x.n, y.n)::DOUBLE * 50.0::DOUBLE / 100.0::DOUBLE))"""


@query(f"WITH {_PERCENT} SELECT src, dst, matches FROM ed")
def edges_percent_threshold(spark, sf):
    h = materialize(_hashes(spark, sf, 125), "hashes")
    return similarity.edges(similarity.hamming_matches(h, 22), h, percent=50.0)


_IDS = "ids AS (SELECT DISTINCT video_id AS id FROM u)"


@query(f"WITH RECURSIVE {_pairs_sql(250, 18)}, {_IDS}, {_components_sql('c', 'ids')} SELECT root AS group_id, id AS video_id FROM (SELECT *, count(*) OVER (PARTITION BY root) AS k FROM r) WHERE k >= 2")
def duplicate_groups(spark, sf):
    """Flagship: pack hashes, join within the radius, count, threshold, components; groups of two or more."""
    h = materialize(_hashes(spark, sf, 250), "hashes")
    e = similarity.edges(similarity.hamming_matches(h, 18), h, number=1)
    return groups.with_duplicates(groups.membership(_ids(h), e))


@query(f"WITH RECURSIVE {_PERCENT}, {_IDS}, {_components_sql('ed', 'ids')} SELECT root AS group_id, count(*) AS members, list_sort(list(id))::VARCHAR AS video_ids FROM r GROUP BY root")
def all_components_with_singletons(spark, sf):
    h = materialize(_hashes(spark, sf, 125), "hashes")
    params = settings.SearchParams(method=settings.HashMethod.SLOW, slowHash=settings.SlowHash(hammingDistance=22, usePercentThreshold=True, matchingThresholdPct=50.0))
    m = groups.members(search.find_duplicates(_ids(h), h, params))
    return m.select("group_id", F.size("video_ids").cast("long").alias("members"), F.concat(F.lit("["), F.array_join("video_ids", ", "), F.lit("]")).alias("video_ids"))


_CHAINS = """
WITH ed AS (SELECT DISTINCT o_orderkey // 4 AS src FROM orders WHERE o_orderkey // 4 % 40 <> 39),
v AS (SELECT src AS id FROM ed UNION SELECT src + 1 FROM ed),
s AS (SELECT v.id, CASE WHEN ed.src IS NULL THEN v.id END AS head FROM v LEFT JOIN ed ON ed.src = v.id - 1)
SELECT id, max(head) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS component FROM s
"""


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    """Links of neighbours, in chains of up to 40 vertices, over all orders. In SQL, a chain begins where no link leads to a vertex."""
    k = F.floor(F.col("o_orderkey") / 4)
    return _t(spark, sf, "orders").where(k % 40 != 39).select(k.alias("src"), (k + 1).alias("dst"))


@query(_CHAINS)
def components_chain(spark, sf):
    return connected_components(_chain(spark, sf), small=groups.SMALL_GRAPH)


@query(_CHAINS)
def components_chain_whole(spark, sf):
    """The same by large-star and small-star rounds, whatever the graph's size."""
    return connected_components(_chain(spark, sf))


# Reports, selection and order, over documents as videos.


def _videos(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group_id"), F.col("n_chars").alias("size"), "lang")


@query("""
WITH g AS (SELECT source, count(*) AS members, sum(n_chars)::BIGINT AS total_size FROM documents GROUP BY source HAVING count(*) >= 2),
k AS (SELECT *, row_number() OVER (ORDER BY source) AS number FROM g)
SELECT source AS group_id, number, members, total_size,
printf('Group %d (%d Duplicates - Size: %.2f GB)', number, members, total_size::DOUBLE * 1000000 / 1073741824) AS label,
printf('%.2f Mbps', total_size::DOUBLE / 1e6) AS rate FROM k
""")
def group_report(spark, sf):
    d = _videos(spark, sf)
    other = {"path": "string", "bit_rate": "int", "width": "int", "height": "int", "avg_frame_rate": "double", "duration": "int", "video_codec": "string", "pix_fmt": "string", "profile": "string", "thumbnail_path": "array<string>"}
    rows = d.select("id", "group_id", (F.col("size") * 1000000).alias("size"), *[F.lit(None).cast(t).alias(c) for c, t in other.items()])
    heads = groups.report(rows).where("row_type = 'group'").select("group_id", F.col("number").cast("long").alias("number"), "label")
    return heads.join(groups.sizes(d), "group_id").select("group_id", "number", "members", "total_size", "label", media.bit_rate_label(F.col("total_size")).alias("rate"))


def _selection_sql(order: str) -> str:
    return f"SELECT doc_id AS id, source AS group_id, row_number() OVER (PARTITION BY source ORDER BY n_chars {order}, doc_id) > 1 AS selected FROM documents"


@query(_selection_sql("DESC"))
def select_except_largest(spark, sf):
    return groups.except_extreme(_videos(spark, sf), "group_id", "size", "id", largest=True).select("id", "group_id", "selected")


@query(_selection_sql("ASC"))
def select_except_smallest(spark, sf):
    return groups.except_extreme(_videos(spark, sf), "group_id", "size", "id", largest=False).select("id", "group_id", "selected")


@query("SELECT doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS falling, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rising FROM documents")
def sort_within_groups(spark, sf):
    falling = groups.place_in_group(_videos(spark, sf), "group_id", "size", "id", name="falling")
    return groups.place_in_group(falling, "group_id", "size", "id", ascending=True, name="rising").select("id", "falling", "rising")


@query("WITH g AS (SELECT source AS group_id, sum(n_chars)::BIGINT AS total_size FROM documents GROUP BY source) SELECT *, row_number() OVER (ORDER BY total_size DESC, group_id) AS place FROM g")
def sort_groups_by_size(spark, sf):
    return groups.group_places(_videos(spark, sf), "group_id", "size").withColumn("place", F.col("place").cast("long"))


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1 AS first_row FROM embeddings")
def first_in_group_flag(spark, sf):
    return groups.first_in_group(_t(spark, sf, "embeddings"), "label", "vec_id").select("vec_id", "label", "first_row")


@query("SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) AS place FROM customer")
def scan_by_id(spark, sf):
    """A table in the order of its ids, numbered by range partitions instead of one task."""
    rows = store.with_ids(_t(spark, sf, "customer").select("c_custkey"), 0, "c_custkey")
    return rows.select(F.col("c_custkey").alias("id"), F.col("id").cast("long").alias("place"))


@query("SELECT median_of.vec_id, median_of.m FROM (SELECT vec_id, (list_sort(list_transform(embedding, lambda x: x::DOUBLE))[32] + list_sort(list_transform(embedding, lambda x: x::DOUBLE))[33]) / 2 AS m FROM embeddings) median_of")
def median_of_block(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", hashing.median64(F.transform("embedding", lambda x: x.cast("double"))).alias("m"))


@query("SELECT doc_id, list_transform(range(1, least(n_chars % 6, 4) + 1), lambda i: 't' || i)::VARCHAR AS thumbs FROM documents")
def limit_thumbnails(spark, sf):
    n = (F.col("n_chars") % 6).cast("int")
    made = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("t"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(groups.shown_thumbnails(made), ", "), F.lit("]")).alias("thumbs"))


# Joins.


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def known_path_antijoin(spark, sf):
    found, known = (_t(spark, sf, name).select(F.col("doc_id").alias("path")) for name in ("documents", "labels"))
    return search.unseen(found, known).select(F.col("path").alias("doc_id"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def selected_semijoin(spark, sf):
    return actions.selected_rows(_t(spark, sf, "documents").select("doc_id", "source"), _t(spark, sf, "labels").where("quality = 1"), "doc_id")


@query("SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def remove_ids_antijoin(spark, sf):
    return store.without(_t(spark, sf, "pages").select("page_id", "url"), "page_id", _t(spark, sf, "labels").where("toxic = 0"), "doc_id")


@query("SELECT d.doc_id, count(*) AS links FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id")
def id_lookup_join(spark, sf):
    """Edges to unknown ids are dropped, not sent to the first row."""
    edges = _t(spark, sf, "labels").select(F.col("doc_id").alias("src"), F.col("doc_id").alias("dst"))
    known = groups.known_edges(_t(spark, sf, "documents").select(F.col("doc_id").alias("id")), edges)
    return known.groupBy(F.col("src").alias("doc_id")).agg(F.count(F.lit(1)).alias("links"))


@query("SELECT count(*) AS found, count(l.doc_id) AS known, count(*) - count(l.doc_id) AS new FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def incremental_new_counts(spark, sf):
    return search.known_counts(*(_t(spark, sf, name).select(F.col("doc_id").alias("path")) for name in ("documents", "labels")))


@query("SELECT p.page_id, CASE WHEN l.doc_id IS NULL THEN './sneed.png' ELSE 'thumb' || l.doc_id END AS thumbnail FROM pages p LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON p.page_id = l.doc_id")
def thumb_left_join_default(spark, sf):
    made = _t(spark, sf, "labels").select(F.col("doc_id").alias("page_id")).distinct().withColumn("thumbs", F.array(F.concat(F.lit("thumb"), F.col("page_id").cast("string"))))
    j = _t(spark, sf, "pages").select("page_id").join(made, "page_id", "left")
    return j.select("page_id", F.array_join(media.or_default_thumbnail(F.col("thumbs")), ",").alias("thumbnail"))


@query("""
SELECT o.c_custkey, o.c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM customer o
LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) n ON o.c_custkey = n.c_custkey
""")
def update_by_id(spark, sf):
    new = _t(spark, sf, "orders").where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return store.upsert(_t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), new, "c_custkey")


@query("SELECT 1 AS id, max(n_name) AS value FROM nation")
def upsert_singleton(spark, sf):
    """One row with id 1: the new value takes the place of the old."""
    old = spark.createDataFrame([(1, "old")], "id int, value string")
    new = _t(spark, sf, "nation").agg(F.max("n_name").alias("value")).select(F.lit(1).alias("id"), "value")
    return store.put(old, new, "id")


_GONE = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"


@query(f"SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_orderkey NOT IN ({_GONE}) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN ({_GONE})")
def cascade_delete(spark, sf):
    orders = _t(spark, sf, "orders")
    gone = orders.where("o_orderstatus = 'F'").select("o_orderkey")
    kept = {"orders": store.without(orders, "o_orderkey", gone, "o_orderkey"), "lineitem": store.without(_t(spark, sf, "lineitem"), "l_orderkey", gone, "o_orderkey")}
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n") for name, rows in kept.items()]
    return counts[0].unionByName(counts[1])


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey = 3 THEN 7 ELSE s_nationkey END AS s_nationkey FROM supplier")
def update_link_count(spark, sf):
    return store.with_value(_t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey", 3, "s_nationkey", 7)


@query("SELECT s.s_suppkey AS id, s.s_name AS path, CASE WHEN s.s_suppkey = 5 THEN x.s_acctbal ELSE s.s_acctbal END AS s_acctbal FROM supplier s CROSS JOIN (SELECT s_acctbal FROM supplier WHERE s_suppkey = 2) x")
def copy_metadata_except_path(spark, sf):
    return store.copy_metadata(_t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("path"), "s_acctbal"), 2, 5)


@query("""
WITH g AS (SELECT label AS group_id, count(*) AS rows_n FROM embeddings GROUP BY label)
SELECT g.group_id, coalesce(k.members, 0) AS members FROM g LEFT JOIN (SELECT e.label, count(*) AS members FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE d.lang = 'en' GROUP BY e.label) k ON g.group_id = k.label
""")
def load_groups(spark, sf):
    """Members that are no videos any more are left out; groups stay, perhaps empty."""
    m = _t(spark, sf, "embeddings").select(F.col("label").alias("group_id"), F.col("vec_id").alias("video_id"))
    videos = _t(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return store.known_members(m, m, videos).select("group_id", F.size("video_ids").cast("long").alias("members"))


# Predicates.

_EXTS = ["A.MKV", "x.mng", "x.mxf", ".mp4", "b.mp4", "c.tar.Ts", "noext", "d.", "e.exe", "dir.avi/f", "g.WebM"]
_EXT_SQL = "WITH f AS (SELECT page_id, url || x AS path FROM pages, (SELECT unnest(" + repr(["/" + e for e in _EXTS]) + ") AS x)), q AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM f), z AS (SELECT *, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS ext FROM q)"


def _file_paths(spark: SparkSession, sf: str) -> DataFrame:
    tails = F.explode(F.array(*[F.lit("/" + e) for e in _EXTS]))
    return _t(spark, sf, "pages").select("page_id", "url", tails.alias("tail")).select("page_id", F.concat("url", "tail").alias("path"))


@query(_EXT_SQL + " SELECT page_id, path, ext FROM z WHERE ext IN (" + ", ".join(f"'{e}'" for e in filters.VIDEO_EXTENSIONS) + ")")
def ext_filter_default(spark, sf):
    return _file_paths(spark, sf).where(filters.by_extension(F.col("path"))).withColumn("ext", media.extension(F.col("path")))


@query(_EXT_SQL + " SELECT page_id, path FROM z WHERE ext IN ('exe', 'mp4')")
def ext_filter_user(spark, sf):
    return _file_paths(spark, sf).where(filters.by_extension(F.col("path"), [".EXE", " mp4 ", ""]))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 200 AND n_chars <= 2000")
def size_range_filter(spark, sf):
    return _t(spark, sf, "documents").where(filters.by_size(F.col("n_chars"), 200, 2000)).select("doc_id", "n_chars")


_PAGE = "WITH f AS (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS name, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent FROM pages)"


@query(_PAGE + """ SELECT 'include' AS mode, page_id FROM f WHERE regexp_matches(name, '^1') OR regexp_matches(parent, 'blog')
UNION ALL SELECT 'exclude', page_id FROM f WHERE NOT (regexp_matches(name, '[?]page') OR regexp_matches(parent, '/en$|/de$'))""")
def include_exclude_filter(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", media.file_name(F.col("url")).alias("name"), media.parent_path(F.col("url")).alias("parent"))
    rules = {"include": (["^1"], ["blog"], [".*"], [".*"]), "exclude": ([], [], ["[?]page"], ["/en$|/de$"])}
    parts = [p.where(filters.include_exclude(F.col("name"), F.col("parent"), *r)).select(F.lit(m).alias("mode"), "page_id") for m, r in rules.items()]
    return parts[0].unionByName(parts[1])


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^.*[Pp].*$') OR regexp_matches(p_name, '(?i)^part.1.*$')")
def glob_filter(spark, sf):
    patterns = filters.compile_patterns(["*[Pp]*", "*p*", "*P*"], use_glob=True)[0] + filters.compile_patterns(["part?1*"], use_glob=True, ignore_case=True)[0]
    return _t(spark, sf, "part").where(filters.match_any(F.col("p_name"), patterns)).select("p_partkey", "p_name")


@query("SELECT c_custkey, regexp_matches(c_name, '0[13]') AS matches FROM customer")
def pattern_sandbox(spark, sf):
    return filters.pattern_test(_t(spark, sf, "customer"), "c_name", "0[13]").select("c_custkey", "matches")


@query(_PAGE + " SELECT page_id, name, parent, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS ext, CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^(.+)\\.[^.]*$', 1) ELSE name END AS stem FROM f")
def path_parts(spark, sf):
    u = F.col("url")
    return _t(spark, sf, "pages").select("page_id", media.file_name(u).alias("name"), media.parent_path(u).alias("parent"), media.extension(u).alias("ext"), media.stem(u).alias("stem"))


@query("SELECT page_id, '/data/' || page_id || '/x.mp4' AS path FROM pages")
def normal_paths(spark, sf):
    messy = F.concat(F.lit("file:///data//./"), F.col("page_id").cast("string"), F.lit("/.//x.mp4/"))
    return _t(spark, sf, "pages").select("page_id", media.normal_path(messy).alias("path"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 20000 AND l_tax > 0")
def probe_validity(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("duration"), (F.col("l_extendedprice") - 20000).alias("width"), F.col("l_tax").alias("height"))
    return filters.valid_probe(rows).select("l_orderkey", "l_linenumber")


@query("SELECT user_id FROM events GROUP BY user_id HAVING NOT bool_or(event_id % 50 = 0)")
def fatal_discard(spark, sf):
    e = _t(spark, sf, "events").select("user_id", (F.col("event_id") % 50 == 0).alias("fatal"))
    return sampling.without_fatal(e, "user_id", "fatal").select("user_id").distinct()


@query("""
WITH x AS (SELECT event_id, (event_id % 90)::INT AS radius, (event_id % 12000)::INT AS threshold, (event_id % 60)::INT AS skip, (event_id % 7)::INT AS thumbs FROM events)
SELECT event_id, greatest(0, least(64, radius)) AS radius, greatest(1, least(10000, threshold)) AS threshold, greatest(0, least(40, skip)) AS skip, greatest(1, least(4, thumbs)) AS thumbs FROM x
""")
def parameter_clamps(spark, sf):
    e = F.col("event_id")
    values = {"radius": (90, "hammingDistance"), "threshold": (12000, "matchingThreshold"), "skip": (60, "skipPercent"), "thumbs": (7, "thumbnailsPerVideo")}
    return _t(spark, sf, "events").select("event_id", *[settings.clamp_column((e % n).cast("int"), name).alias(k) for k, (n, name) in values.items()])


@query("""
SELECT event_id, least(64, event_id % 90)::INTEGER AS radius, greatest(1, least(10000, event_id % 12000)) AS threshold, CASE WHEN event_id % 12 IN (2, 10) THEN event_id % 12 ELSE 2 END::INTEGER AS frames,
       CASE WHEN event_id % 3 = 0 THEN true ELSE event_id % 2 = 0 END AS fast_keys, CASE WHEN event_id % 3 = 0 THEN false ELSE event_id % 2 = 0 END AS slow_keys,
       greatest(1.0::DOUBLE, least(100.0::DOUBLE, value)) AS pct, CASE WHEN event_id % 4 > 0 THEN event_id END AS min_bytes, greatest(1, least(4, event_id % 7))::INTEGER AS thumbs, event_type AS folder
FROM events WHERE event_id % 11 > 0 UNION ALL SELECT event_id, 4, 2, 2, true, true, 50.0::DOUBLE, NULL, 4, NULL FROM events WHERE event_id % 11 = 0
""")
def settings_json_roundtrip(spark, sf):
    """Settings from the events' numbers, as an older text without keyframe flags where the id is divisible by 3, through the codec; texts that are cut off give the defaults."""
    e, n = F.col("event_id"), lambda k: (F.col("event_id") % k).cast("int")
    keys = F.when(e % 3 > 0, e % 2 == 0).alias("useKeyframesOnly")
    fast = F.struct(n(12).alias("maxFrames"), n(90).alias("hammingDistance"), (e % 12000).alias("matchingThreshold"), keys)
    slow = F.struct(F.lit(15).alias("skipPercent"), F.lit(9).alias("maxFrames"), n(90).alias("hammingDistance"), F.lit(True).alias("usePercentThreshold"), F.col("value").alias("matchingThresholdPct"), e.alias("matchingThresholdNum"), keys)
    none = F.array().cast("array<string>")
    lists = [none.alias(k) for k in ("extensions", "includeFilePatterns", "includeDirPatterns", "excludeFilePatterns", "excludeDirPatterns")]
    folders = F.array(F.struct(F.col("event_type").alias("path"), F.lit(True).alias("recursive"))).alias("directories")
    whole = F.struct(F.lit(True).alias("useGlob"), F.lit(False).alias("caseInsensitive"), *lists, folders, n(7).alias("thumbnailsPerVideo"), F.when(e % 4 > 0, e).alias("minBytes"), F.lit(1).alias("method"), fast.alias("fastHash"), slow.alias("slowHash"))
    text = F.to_json(whole)
    cut = F.when(e % 11 > 0, text).otherwise(F.substr(text, F.lit(1), F.length(text) - 1))
    back = F.from_json(settings.recoded(cut), schemas.SETTINGS)
    return _t(spark, sf, "events").select("event_id", back.alias("s")).select(
        "event_id", "s.fastHash.hammingDistance", "s.fastHash.matchingThreshold", "s.fastHash.maxFrames", F.col("s.fastHash.useKeyframesOnly").alias("f"), F.col("s.slowHash.useKeyframesOnly").alias("k"),
        "s.slowHash.matchingThresholdPct", "s.minBytes", "s.thumbnailsPerVideo", F.get("s.directories", F.lit(0))["path"].alias("folder"),
    ).toDF("event_id", "radius", "threshold", "frames", "fast_keys", "slow_keys", "pct", "min_bytes", "thumbs", "folder")


@query("""
WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS line FROM documents)
SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM l GROUP BY doc_id
""")
def text_list_parse(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.explode(settings.split_lines(F.col("text"))).alias("line"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("SELECT n_nationkey, lower(trim(n_name)) || ',x' AS list FROM nation")
def comma_list_parse(spark, sf):
    messy = F.concat(F.lit(" "), F.col("n_name"), F.lit(" ,, X,"))
    return _t(spark, sf, "nation").select("n_nationkey", F.array_join(settings.split_list(messy), ",").alias("list"))


@query("SELECT r_regionkey, '• ' || string_agg(n_name, chr(10) || '• ' ORDER BY n_name) AS errors FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def error_list(spark, sf):
    names = _t(spark, sf, "nation").join(F.broadcast(_t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return names.groupBy("r_regionkey").agg(filters.error_column(F.sort_array(F.collect_list("n_name"))).alias("errors"))


# Frames, times and labels.

_TICKS = "SELECT event_id, user_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS pts FROM events"


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = _t(spark, sf, "events").select("event_id", "user_id", us.alias("us"))
    return e.select("event_id", "user_id", (F.col("us") - F.min("us").over(Window.partitionBy("user_id"))).alias("pts"))


_STEP = 24 * 3600 * 1_000_000


def _sampled_sql(key: str, step: int) -> str:
    return f"""
WITH t AS (SELECT event_id, {key}, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY {key}) AS pts FROM events), x AS (SELECT *, row_number() OVER w AS n, greatest(floor(pts / {step}.0::DOUBLE), -1) AS f FROM t WINDOW w AS (PARTITION BY {key} ORDER BY pts, event_id)),
k AS (SELECT *, greatest(0, least(n, n + min(f + 1 - n) OVER (PARTITION BY {key} ORDER BY pts, event_id ROWS UNBOUNDED PRECEDING))) AS kept FROM x)
SELECT event_id, {key}, kept > lag(kept, 1, 0) OVER (PARTITION BY {key} ORDER BY pts, event_id) AS due FROM k
"""


@query(_sampled_sql("user_id", _STEP))
def greedy_sampler(spark, sf):
    return sampling.sample_frames(_frames(spark, sf), "user_id", "pts", float(_STEP), "event_id").select("event_id", "user_id", "due")


@query(_sampled_sql("event_type", _STEP // 24))
def greedy_sampler_chunks(spark, sf):
    """By chunks that are put together in a tree: few videos, of any length, are many tasks."""
    e = _t(spark, sf, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = e.groupBy("event_type").agg(F.min("us").alias("first"))
    frames = e.join(first, "event_type").select("event_id", "event_type", (F.col("us") - F.col("first")).alias("pts"))
    return sampling.sample_chunks(frames, "event_type", "pts", float(_STEP // 24), "pts", "event_id", chunk=128, fan=4).select("event_id", "event_type", "due")


@query(f"""
WITH t AS ({_TICKS}), d AS (SELECT user_id, max(pts) AS duration FROM t GROUP BY user_id),
g AS (SELECT user_id, unnest([(0.30::DOUBLE * duration)::DOUBLE, (0.70::DOUBLE * duration)::DOUBLE]) AS target FROM d),
p AS (SELECT t.user_id, g.target, min(t.pts) AS pts FROM t JOIN g ON t.user_id = g.user_id AND t.pts >= g.target GROUP BY ALL),
v AS (SELECT p.user_id, p.target, p.pts, min(t.event_id) AS event_id FROM p JOIN t ON t.user_id = p.user_id AND t.pts = p.pts GROUP BY ALL)
SELECT user_id, pts, event_id, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS k FROM v) WHERE k = 2 GROUP BY user_id, pts, event_id
""")
def asof_targets_30_70(spark, sf):
    f = _frames(spark, sf)
    duration = f.groupBy("user_id").agg(F.max("pts").cast("double").alias("duration"))
    targets = duration.select("user_id", F.explode(media.seek_targets(F.col("duration"))).alias("target")).distinct()
    picked = sampling.both_or_none(sampling.forward_asof(f, targets, "user_id", "pts", "target", "event_id"), "user_id")
    return picked.groupBy("user_id", "pts", "event_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, i, (i + 1) * n_chars::DOUBLE / (doc_id % 4 + 2) AS at FROM (SELECT doc_id, n_chars, unnest(range(0, doc_id % 4 + 1)) AS i FROM documents)")
def thumbnail_times(spark, sf):
    n = (F.col("doc_id") % 4 + 1).cast("int")
    return _t(spark, sf, "documents").select("doc_id", F.posexplode(media.thumbnail_times(F.col("n_chars"), n)).alias("i", "at")).select("doc_id", F.col("i").cast("long").alias("i"), "at")


@query("SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') || '_' || substr(sha1(url), 1, 8) || printf('_thumb-%03d.jpg', page_id % 5) AS name FROM pages")
def thumbnail_names(spark, sf):
    return _t(spark, sf, "pages").select("page_id", media.thumbnail_name(F.col("url"), (F.col("page_id") % 5).cast("int")).alias("name"))


@query("SELECT l_orderkey, l_linenumber, round(rint_us * 30000 / (1001 * 1e6::DOUBLE))::BIGINT AS pts FROM (SELECT *, round_even(l_extendedprice * 1e6::DOUBLE, 0) AS rint_us FROM lineitem)")
def pts_rescale(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", media.seconds_to_pts(F.col("l_extendedprice"), F.lit(1001), F.lit(30000)).alias("pts"))


@query("SELECT l_orderkey, l_linenumber, trunc(l_extendedprice * 1000 / 1e6::DOUBLE)::INT AS seconds, CASE WHEN l_linenumber - 2 > 0 THEN l_quantity / (l_linenumber - 2) ELSE 0.0::DOUBLE END AS fps FROM lineitem")
def duration_fps(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", media.duration_seconds(F.col("l_extendedprice") * 1000).alias("seconds"), media.frame_rate(F.col("l_quantity"), F.col("l_linenumber") - 2).alias("fps"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS modified_at FROM orders")
def mtime_format(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", media.local_time(F.col("o_orderdate")).alias("modified_at"))


@query("""
SELECT doc_id, printf('%.2f GB', n_chars * 1000000 / 1073741824.0::DOUBLE) AS size_text, printf('%d.%02d Mbps', (n_chars * 1000 + 5000) // 1000000, (n_chars * 1000 + 5000) % 1000000 // 10000) AS rate_text,
n_chars || 'x' || doc_id AS resolution, CASE WHEN lang = 'en' THEN 'unknown' ELSE lang END AS codec FROM documents
""")
def display_labels(spark, sf):
    n = F.col("n_chars")
    codec = media.or_unknown(F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang")))
    return _t(spark, sf, "documents").select("doc_id", media.size_label(n * 1000000).alias("size_text"), media.bit_rate_label(n * 1000).alias("rate_text"), media.resolution_label(n, F.col("doc_id")).alias("resolution"), codec.alias("codec"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'one' WHEN 2 THEN 'raw/path.jpg' ELSE '' END AS thumbs FROM pages")
def thumbnail_decode(spark, sf):
    k = F.col("page_id") % 4
    stored = F.when(k == 0, F.lit('["a","b"]')).when(k == 1, F.lit('"one"')).when(k == 2, F.lit("raw/path.jpg")).otherwise(F.lit(""))
    return _t(spark, sf, "pages").select("page_id", F.array_join(media.decode_thumbnails(stored), "|").alias("thumbs"))


# Actions.

_LINK = """
WITH d AS (SELECT doc_id AS video_id, n_chars // 300 AS group_id, doc_id AS position, doc_id % 4 <> 3 AS selected, doc_id % 7 AS inode, 1 AS device FROM documents),
s AS (SELECT *, sum(selected::INT) OVER g AS k, min(CASE WHEN selected THEN position END) OVER g AS first_pos FROM d WINDOW g AS (PARTITION BY group_id)),
x AS (SELECT s.*, CASE WHEN k >= 2 THEN f.video_id END AS source_id, f.inode AS si FROM s LEFT JOIN d f ON f.group_id = s.group_id AND f.position = s.first_pos),
a AS (SELECT *, CASE WHEN source_id IS NULL THEN 'none' WHEN video_id = source_id THEN 'source' WHEN selected AND inode = si THEN 'already' WHEN selected THEN 'link' ELSE 'none' END AS action FROM x),
b AS (SELECT *, source_id IS NOT NULL AND (inode = si OR action = 'link') AS same FROM a)
"""


@query(_LINK + "SELECT group_id, video_id, source_id, action, CASE WHEN same THEN sum(same::INT) OVER (PARTITION BY group_id) END::BIGINT AS new_links FROM b")
def hardlink_plan(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), F.floor(F.col("n_chars") / 300).alias("group_id"), F.col("doc_id").alias("position"), (F.col("doc_id") % 4 != 3).alias("selected"), (F.col("doc_id") % 7).alias("inode"), F.lit(1).cast("long").alias("device"))
    return actions.hardlink_plan(d).select("group_id", "video_id", "source_id", "action", "new_links")


@query("SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'database' ELSE 'stays' END AS fate FROM documents")
def delete_plan(spark, sf):
    videos = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    chosen = _t(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    stays, gone = actions.delete_plan(videos, chosen, "database")
    return stays.select("id", F.lit("stays").alias("fate")).unionByName(gone.select("id", F.col("mode").alias("fate")))


@query("SELECT DISTINCT url AS path FROM pages")
def union_directories_dedup(spark, sf):
    p = _t(spark, sf, "pages").select(F.col("url").alias("path"))
    return scans.union_directories([p, p.where("path LIKE '%blog%'")])


@query("SELECT path, max(recursive::INT) = 1 AS recursive FROM (SELECT n_name AS path, n_nationkey % 2 = 0 AS recursive FROM nation WHERE n_regionkey <> 2) GROUP BY path")
def directory_list(spark, sf):
    """Adding a directory twice keeps the first entry; removed ones go."""
    n = _t(spark, sf, "nation").select(F.col("n_name").alias("path"), (F.col("n_nationkey") % 2 == 0).alias("recursive"), "n_regionkey")
    return settings.keep_directories(n, n.withColumn("recursive", ~F.col("recursive")), n.where("n_regionkey = 2"))


@query()
def fs_scan(spark, sf):
    """The files of the tables' own folder."""
    return scans.with_identity(scans.scan(spark, sf)).select("path", "size", "num_hard_links", "modified_at")
