"""Merkle manifest of a dataset: each row's leaf, roots, and proofs by fractal traversal.

A leaf is the SHA-256 of a row's fields, each ``-`` if null, else its length in
bytes, a colon and its value. A source's leaves stand in the order of their
doc_id; runs of ``ARITY`` nodes become their hash until one is left, the
source's subroot; subroots in the order of their sources become the root in the
same way. Hashes are of the lower-case hex digits of what they cover.

1. Leaves are hashed where the texts are read; from there on only digests move.
   A leaf's place in its source is its place in a range partition plus the
   source's leaves in the partitions before.
2. Leaves are gathered in aligned blocks of ``ARITY ** LEVELS``, whatever the
   size of their source. A task folds a block to its root.
3. Block roots, a thousandth of the leaves, become subroots and the root level
   by level, one aggregation each; going down again, each node's siblings are
   put before its parent's proof: the upper proofs, one for each block.
4. A block's proofs come from a fractal traversal (``Traversal``): for each
   level it keeps the existing run of nodes, from which siblings are read, and
   the desired next run, which grows by a leaf at each step. Both are bounded
   by the arity and the levels. The block's upper proof is put behind.

No source, however large, meets in one task, and no list of sources does.

Defined results: null fields count as ``-``; rows with a null doc_id come first
in their source; rows with equal ids stand in the order of their leaves, and
equal rows, which have equal leaves, in any; a lone leaf is its source's
subroot, and a lone subroot the root; a proof without siblings is empty; an
empty table gives no rows; columns besides the five fields are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearmatch.llm.common import materialize, own, shuffle_partitions, table, text_batches

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 16
#: Levels of an aligned block; it has ARITY ** LEVELS leaves of 32 bytes.
LEVELS = 3
#: Rows of a batch that goes back to Spark.
BATCH = 2048

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    """The 32 bytes of a row's leaf."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]), 256))


def digest(nodes: Sequence[bytes]) -> bytes:
    """The node above a run of nodes."""
    return sha256("".join([x.hex() for x in nodes]).encode()).digest()


def height_of(leaves: int, arity: int) -> int:
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // arity), height + 1
    return height


class Desired:
    """The next run of nodes of one level, from leaves that come one at a time."""

    def __init__(self, leaves: Iterator[bytes], level: int, arity: int) -> None:
        self.leaves, self.level, self.arity = leaves, level, arity
        self.tails: list[list[bytes]] = [[] for _ in range(level + 1)]

    def step(self) -> None:
        leaf = next(self.leaves, None)
        if leaf is None:
            return
        self.tails[0].append(leaf)
        for at in range(self.level):
            if len(self.tails[at]) == self.arity:
                self._lift(at)

    def _lift(self, at: int) -> None:
        self.tails[at + 1].append(digest(self.tails[at]))
        self.tails[at] = []

    def take(self) -> list[bytes]:
        """The run, of which the last may be short; the next one starts."""
        for at in range(self.level):
            if self.tails[at]:
                self._lift(at)
        run, self.tails[-1] = self.tails[-1], []
        return run


class Traversal:
    """The authentication paths of a block's leaves, one after another."""

    def __init__(self, leaves: Sequence[bytes], height: int, arity: int = ARITY) -> None:
        self.leaves, self.height, self.arity = leaves, height, arity
        self.desired = [Desired(iter(leaves), level, arity) for level in range(height)]
        self.existing: list[list[bytes]] = []
        for level, desired in enumerate(self.desired):
            for _ in range(min(arity ** (level + 1), len(leaves))):
                desired.step()
            self.existing.append(desired.take())

    @property
    def root(self) -> bytes:
        return digest(self.existing[-1]) if self.height else self.leaves[0]

    def paths(self) -> Iterator[list[tuple[int, list[bytes]]]]:
        """For each leaf, level by level: its node's place in its run, and the run's others."""
        for i in range(len(self.leaves)):
            path = []
            for level, run in enumerate(self.existing):
                place = i // self.arity**level % self.arity
                path.append((place, run[:place] + run[place + 1 :]))
            yield path
            for level, desired in enumerate(self.desired):
                desired.step()
                if (i + 1) % self.arity ** (level + 1) == 0:
                    self.existing[level] = desired.take()


def fold(node: bytes, path: Sequence[tuple[int, Sequence[bytes]]]) -> bytes:
    """What a node and its siblings say the root is."""
    for place, others in path:
        node = digest([*others[:place], node, *others[place:]])
    return node


def split(others: bytes) -> list[bytes]:
    return [others[k : k + 32] for k in range(0, len(others), 32)]


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with pos, a row's place in its group from 0, in an order; rows are read twice."""
    tie, at = own("tie"), own("at")
    keys = [F.col(group), *[F.col(c) for c in order], F.col(tie)]
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    # the upper bits are the partition, the lower 33 the place in it
    numbered = materialize(ranged.withColumn(at, F.monotonically_increasing_id()).withColumn("part", F.shiftright(at, 33)).drop(tie), "places")
    runs = numbered.groupBy(group, "part").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = runs.select(group, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"))
    return numbered.join(base, [group, "part"]).withColumn("pos", F.col(at) + F.col("base")).drop(at, "part", "base")


_NODES = "transform(items, x -> lower(hex(x.h)))"


def rise(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """The levels above nodes (grp, pos, h): runs (grp, run, items, h) of each, the last of a group being its lone node, done."""
    levels = []
    while True:
        runs = nodes.groupBy("grp", F.expr(f"pos div {arity}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("items"))
        done = (F.col("run") == 0) & (F.size("items") == 1)
        above = F.when(done, F.get("items", F.lit(0))["h"]).otherwise(F.unhex(F.sha2(F.array_join(F.expr(_NODES), ""), 256)))
        levels.append(materialize(runs.select("grp", "run", "items", done.alias("done"), above.alias("h")), f"level{len(levels)}"))
        left = levels[-1].where("NOT done")
        if left.isEmpty():
            return levels
        nodes = left.select("grp", F.col("run").alias("pos"), "h")


def descend(levels: Sequence[DataFrame], tops: DataFrame) -> DataFrame:
    """grp, pos, proof and the columns of tops of the nodes that levels stand on; tops has grp and the proof of its lone node."""
    carried = [c for c in tops.columns if c not in ("grp", "proof")]
    found: DataFrame | None = None
    for k, level in reversed(list(enumerate(levels))):
        here = level.where("done").select("grp", F.lit(0).cast("long").alias("pos")).join(tops, "grp")
        if found is not None:
            runs = level.where("NOT done").join(found.withColumnRenamed("pos", "run"), ["grp", "run"])
            each = runs.select("grp", "items", "proof", *carried, F.posexplode("items").alias("place", "node"))
            others = F.expr("aggregate(filter(items, x -> x.pos <> node.pos), cast('' as binary), (s, x) -> concat(s, x.h))")
            step = F.struct("place", others.alias("others"))
            here = here.unionByName(each.select("grp", F.col("node.pos").alias("pos"), F.concat(F.array(step), F.col("proof")).alias("proof"), *carried))
        found = materialize(here.select("grp", "pos", "proof", *carried), f"proofs{k}")
    assert found is not None
    return found


_PROOF = "array<struct<place: int, others: binary>>"


def _block_roots(arity: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for block, items in zip(batch.column("block").to_pylist(), batch.column("items")):
                leaves = [x["leaf"].as_py() for x in items]
                roots.append(Traversal(leaves, _height(len(leaves), arity, levels, block), arity).root)
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), pa.array(roots, pa.binary())], ["grp", "pos", "h"])

    return run


def _height(leaves: int, arity: int, levels: int, block: int) -> int:
    """Levels of a block: a first block that isn't full is a whole source, and ends where one node is left."""
    return levels if block or leaves == arity**levels else height_of(leaves, arity)


def _proofs(arity: int, levels: int, with_paths: bool):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["path"] * with_paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, items, upper, subroot, root = (batch.column(c)[row].as_py() for c in ("block", "items", "proof", "subroot", "root"))
                above = [(x["place"], split(x["others"])) for x in upper]
                behind = "".join([y.hex() for _, others in above for y in others]).encode()
                leaves = [x["leaf"] for x in items]
                up: dict[bytes, bytes] = {}  # the root by the block's
                out: list[tuple] = []
                for item, path in zip(items, Traversal(leaves, _height(len(leaves), arity, levels, block), arity).paths()):
                    top = fold(item["leaf"] if item["found"] is None else item["found"], path)
                    if top not in up:
                        if len(up) > arity:
                            up.clear()
                        up[top] = fold(top, above)
                    proof = sha256("".join([y.hex() for _, others in path for y in others]).encode() + behind)
                    more = ([{"place": p, "others": b"".join(o)} for p, o in [*path, *above]],) if with_paths else ()
                    out.append((item["doc_id"], item["leaf"].hex(), subroot.hex(), root.hex(), proof.hexdigest(), up[top].hex(), up[top] == root, *more))
                    if len(out) == BATCH:
                        yield _batch(out, names, batch.schema)
                        out = []
                if out:
                    yield _batch(out, names, batch.schema)

    return run


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    kinds = {"doc_id": schema.field("items").type.value_type.field("doc_id").type, "verified": pa.bool_(), "path": pa.list_(pa.struct([("place", pa.int32()), ("others", pa.binary())]))}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names)


def leaves(docs: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """grp, doc_id, leaf, found of docs. found is the leaf of the row with the columns of tampered in place of its own, where so; else null.

    grp stands for the source and sorts as sources do: null first.
    """
    at = [F.col(c) for c in FIELDS]
    now = [(tampered or {}).get(c, F.col(c)) for c in FIELDS]
    found = F.when(where, leaf_of(now)) if where is not None else F.lit(None).cast("binary")
    group = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    return docs.select(group.alias("grp"), "doc_id", leaf_of(at).alias("leaf"), found.alias("found"))


def manifest(leaves: DataFrame, arity: int = ARITY, levels: int = LEVELS, with_paths: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of leaves (see there).

    folded_root is computed from the leaf found, if there is one, and the
    siblings of the proof. With paths, path has each level's place and the
    run's other digests, from the leaf to the root.
    """
    rows = placed(materialize(leaves, "leaves"), "grp", ["doc_id", "leaf"])
    item = F.struct("pos", "doc_id", "leaf", "found")
    blocks = rows.groupBy("grp", F.expr(f"pos div {arity**levels}").alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    blocks = materialize(blocks, "blocks")
    sources = rise(blocks.mapInArrow(_block_roots(arity, levels), "grp string, pos long, h binary"), arity)
    subroots = materialize(reduce(DataFrame.unionByName, [x.where("done").select("grp", "h") for x in sources]), "subroots")
    order = placed(subroots.select(F.lit("").alias("all"), F.col("grp").alias("source"), "h"), "all", ["source"]).select(F.col("all").alias("grp"), "pos", "h", "source")
    order = materialize(order, "sources")
    top = rise(order.select("grp", "pos", "h"), arity)
    root = reduce(DataFrame.unionByName, [x.where("done").select("grp", F.col("h").alias("root")) for x in top])
    tops = root.withColumn("proof", F.array().cast(_PROOF))
    of_source = order.join(descend(top, tops), ["grp", "pos"]).select(F.col("source").alias("grp"), "proof", F.col("h").alias("subroot"), "root")
    upper = descend(sources, materialize(of_source, "source-proofs"))
    work = blocks.join(upper.withColumnRenamed("pos", "block"), ["grp", "block"]).select("block", "items", "proof", "subroot", "root")
    kind = leaves.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", path {_PROOF}" * with_paths
    return work.mapInArrow(_proofs(arity, levels, with_paths), schema)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    lowered = F.translate("text", _UPPER, _LOWER)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(leaves(docs, {"text": lowered}, tampered))


def _sql(levels: int = 6, top: int = 3) -> str:
    """levels of a source's tree and of the tree above: what 16 ** levels documents of a source need."""
    f = lambda c: f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    parts = [
        # CRC-32, bit by bit over the bytes of the decimal number
        "c AS (SELECT *, xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT), lambda a, x: list_reduce(range(8), lambda v, j: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(a, x)), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM documents)",
        f"leaves AS (SELECT doc_id, coalesce('s' || source, '') AS g, sha256({' || '.join(f(c) for c in FIELDS)}) AS leaf, CASE WHEN crc % 5 = 0 THEN sha256({' || '.join(f(lower if c == 'text' else c) for c in FIELDS)}) END AS found FROM c)",
        "n0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS h, count(*) OVER (PARTITION BY g) AS c, doc_id, found FROM leaves)",
    ]

    def tree(name: str, k: int) -> None:
        parts.append(f"{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM (SELECT g, p // 16 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM {name}{k} WHERE c > 1 GROUP BY g, p // 16))")

    def siblings(name: str, k: int) -> None:
        parts.append(
            f"s{name}{k} AS (SELECT a.g, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.p // 16 = b.p // 16 WHERE a.c > 1 GROUP BY a.g, a.p)"
        )

    for k in range(levels):
        tree("n", k)
        siblings("n", k)
    parts.append("sub AS (" + " UNION ALL ".join(f"SELECT g, h FROM n{k} WHERE c = 1" for k in range(levels + 1)) + ")")
    parts.append("t0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS p, h, count(*) OVER () AS c, g AS src FROM sub)")
    for k in range(top):
        tree("t", k)
        siblings("t", k)
    parts.append("root AS (" + " UNION ALL ".join(f"SELECT h FROM t{k} WHERE c = 1" for k in range(top + 1)) + ")")
    parts.append("w0 AS (SELECT doc_id, g, p, h AS leaf, coalesce(found, h) AS x, '' AS proof FROM n0)")
    step = "SELECT doc_id, w.g, w.p // 16 AS p, leaf, CASE WHEN s.l IS NULL THEN x ELSE sha256(s.l || x || s.r) END AS x, proof || coalesce(s.l || s.r, '') AS proof"
    for k in range(levels):
        parts.append(f"w{k + 1} AS ({step} FROM w{k} w LEFT JOIN sn{k} s ON w.g = s.g AND w.p = s.p)")
    parts.append(f"v0 AS (SELECT doc_id, '' AS g, t0.p, leaf, x, proof, t0.h AS subroot FROM w{levels} w JOIN t0 ON t0.src = w.g)")
    for k in range(top):
        parts.append(f"v{k + 1} AS ({step}, subroot FROM v{k} w LEFT JOIN st{k} s ON w.p = s.p)")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = root.h AS verified FROM v{top}, root"


SQL = _sql()
