"""Conversation prefix trie, rolled up by centroid decomposition.

1. Every conversation is rebuilt as a list of turn digests and becomes one row per prefix: a chained 128-bit digest of
   its first d turns. Rows of one digest are a node. One aggregate gives a node's smallest member, its number of members
   and its ``mass``: the rows of all prefixes below it, its own included.
2. A node belongs to its smallest member, whose nodes are the end of its path, so the trie is stored as one chain for
   each conversation that has nodes of its own: the ids of the nodes on its path and, of its own nodes, the weights.
3. The trie is split at centroids. The nodes that hold more than half of a component's mass are the path from its top to
   its centroid, which is the last of them. What lies at or below the centroid is summed and added to every node of that
   path; then the centroid leaves, and what was below each of its children and what is left above are components of
   their own. Each has at most half of the mass, so a node takes part in a logarithmic number of rounds, however deep
   the trie is, and a pair of a node and one of its descendants is added up in exactly one of them.
4. All components of more than ``local_rows`` rows are split by rounds over the stored chains; their number, and so what
   a round broadcasts, is at most ``MOST``. Smaller ones are dealt out by component and split to the end in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import batch, col_or_empty, drop_table, merge_partitions, query, store, table

SHARED = 8
LOCAL_ROWS = 1 << 14
#: Components of more than a task's share, and nodes that are looked up by broadcast, are never more than so many.
MOST = 1 << 17
CHUNK_BITS = 12
BATCH_ROWS = 1 << 15

ROWS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("left", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("n_bytes", pa.int64())])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of every conversation with its shared opening put in; a turn is (digest, bytes of its text)."""
    role, text = col_or_empty("role"), col_or_empty("text")
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["n_bytes"].alias("n_bytes"))).alias("own"))
    heads = own.select(F.col("conv_id").alias("base"), F.slice("own", 1, SHARED).alias("head"))
    keyed = own.select("*", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (SHARED + 1)).cast("int").alias("h"))
    opening = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("own", F.col("h") + 1, F.size("own"))
    return keyed.join(heads, "base", "left").select("conv_id", F.concat(opening, rest).alias("turns"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """One row for every conversation and depth: the prefix, the one before it, and how many prefixes are left from it on."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            made: dict[str, list] = {f.name: [] for f in ROWS}
            for conv, turns in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                path, n_bytes = [b"\0" * 16], [0]
                for t in turns.values.to_pylist():
                    path.append(blake2b(path[-1] + t["digest"], digest_size=16).digest())
                    n_bytes.append(t["n_bytes"])
                n = len(path)
                made["conv_id"] += [conv] * n
                made["depth"] += range(n)
                made["left"] += range(n, 0, -1)
                made["node"] += path
                made["parent"] += [None, *path[:-1]]
                made["n_bytes"] += n_bytes
                if len(made["depth"]) >= BATCH_ROWS:
                    yield batch(made, ROWS)
                    made = {f.name: [] for f in ROWS}
            yield batch(made, ROWS)

    return rebuilt(conversations).mapInArrow(run, "conv_id bigint, depth bigint, left bigint, node binary, parent binary, n_bytes bigint")


def ends(rows: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the ids that end at a node. Ids are joined in chunks of the id range, which bounds a
    group; the chunks of a node are then hashed one after another as they stream by."""
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    ids = F.array_join(F.transform(F.sort_array(F.collect_set("conv_id")), lambda c: c.cast("string")), ",")
    chunks = rows.where("left = 1").groupBy("node", chunk.alias("chunk")).agg(ids.alias("ids"))
    schema = pa.schema([("node", pa.binary()), ("ends", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, sha256()
        for rb in it:
            nodes, found = [], []
            for node, ids in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                if node != last:
                    if last is not None:
                        nodes.append(last)
                        found.append(state.hexdigest())
                    last, state = node, sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield batch({"node": nodes, "ends": found}, schema)
        if last is not None:
            yield batch({"node": [last], "ends": [state.hexdigest()]}, schema)

    n = merge_partitions(rows.sparkSession)
    return chunks.repartition(n, "node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(run, "node binary, ends string")


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One stored row for each node, with an id."""
    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.sum("left").alias("mass"), F.max("parent").alias("parent"), F.max("n_bytes").alias("n_bytes"))
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    both = nodes.join(kids, "node", "left").join(ends(rows), "node", "left")
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint")
    return store(both.select("node", "owner", "n_convs", "mass", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), F.coalesce("ends", F.lit(sha256().hexdigest())).alias("ends"), F.monotonically_increasing_id().alias("id")))


def chains(rows: DataFrame, nodes: DataFrame, n_rows: int) -> DataFrame:
    """(conv_id, parent_conv_id, path, mass, leaf, saved, first) of the conversations that own nodes.

    Nodes of very many conversations are looked up by broadcast, so that no task gets all rows of one of them; there are
    at most ``MOST`` such nodes, as their rows are rows of the trie.
    """
    cols = ["owner", "id", "mass", "leaf", "saved"]
    bound = max(64, n_rows // MOST)
    hot = nodes.where(F.col("n_convs") > bound).select("node", *cols)
    marked = rows.select("conv_id", "depth", "node").join(F.broadcast(hot), "node", "left")
    cold = marked.where("owner is null").select("conv_id", "depth", "node").join(nodes.where(F.col("n_convs") <= bound).select("node", *cols), "node")
    placed = marked.where("owner is not null").unionByName(cold).select("conv_id", F.struct("depth", *cols).alias("p"))
    paths = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p")).where(F.element_at("p", -1)["owner"] == F.col("conv_id"))
    first = F.size(F.filter("p", lambda x: x["owner"] != F.col("conv_id")))
    own = F.slice("p", first + 1, F.size("p"))
    return paths.select("conv_id", F.get("p", first - 1)["owner"].alias("parent_conv_id"), first.cast("bigint").alias("first"), F.col("p.id").alias("path"), own["mass"].alias("mass"), own["leaf"].alias("leaf"), own["saved"].alias("saved"))


class Chains:
    """A batch of stored chains as flat arrays: one entry for each own node."""

    lists = ("mass", "leaf", "saved", "part", "leaves", "total_saved")

    def __init__(self, rb: pa.RecordBatch):
        self.rb = rb
        path = rb.column("path")
        self.path, self.path_at = path.flatten().to_numpy(), np.append(0, np.cumsum(path.value_lengths().to_numpy()))
        own = rb.column("mass").value_lengths().to_numpy()
        self.own_at = np.append(0, np.cumsum(own))
        for name in self.lists:
            setattr(self, name, rb.column(name).flatten().to_numpy().copy())
        self.chain = np.repeat(np.arange(len(own)), own)
        self.depth = rb.column("first").to_numpy()[self.chain] + np.arange(len(self.chain)) - self.own_at[self.chain]
        self.id = self.path[self.path_at[self.chain] + self.depth]

    def within(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of the components ``parts`` (sorted), and which of them each is in."""
        at = np.minimum(np.searchsorted(parts, self.part), len(parts) - 1)
        here = np.flatnonzero(parts[at] == self.part)
        return here, at[here]

    def passes(self, here: np.ndarray, node: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Whether ``node`` is each node of ``here`` or above it."""
        deep = self.depth[here] >= depth
        place = self.path_at[self.chain[here]] + np.where(deep, depth, 0)
        return deep & (self.path[place] == node)

    def written(self) -> pa.RecordBatch:
        out = {n: pa.ListArray.from_arrays(pa.array(self.own_at.astype(np.int32)), pa.array(getattr(self, n))) for n in self.lists}
        arrays = [out[n] if n in out else self.rb.column(n) for n in self.rb.schema.names]
        return pa.RecordBatch.from_arrays(arrays, names=self.rb.schema.names)


TOPS, PATHS, SUMS = (pa.schema([(n, pa.int64()) for n in names.split()]) for names in ("part mass", "part mass id depth", "part leaves saved"))


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} bigint" for f in schema)


def split_large(state: DataFrame, local_rows: int) -> DataFrame:
    """Rounds over the stored chains until no component holds more than ``local_rows`` rows; a node whose component is -1
    has been a centroid and is done."""
    spark = state.sparkSession

    def each(of) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in it:
                yield of(Chains(rb))

        return run

    while True:

        def tops(c: Chains) -> pa.RecordBatch:
            at = np.flatnonzero((c.part == c.id) & (c.mass > local_rows))
            return batch({"part": c.part[at], "mass": c.mass[at]}, TOPS)

        large = state.mapInArrow(each(tops), ddl(TOPS)).orderBy("part").toPandas()
        if large.empty:
            return state
        parts, totals = large["part"].to_numpy(), large["mass"].to_numpy()

        def paths(c: Chains) -> pa.RecordBatch:
            here, at = c.within(parts)
            on = 2 * c.mass[here] > totals[at]
            here = here[on]
            return batch({"part": c.part[here], "mass": c.mass[here], "id": c.id[here], "depth": c.depth[here]}, PATHS)

        middle = state.mapInArrow(each(paths), ddl(PATHS)).groupBy("part").agg(F.min(F.struct("mass", "id", "depth")).alias("c")).select("part", "c.*").orderBy("part").toPandas()
        mass, node, depth = (middle[n].to_numpy() for n in ("mass", "id", "depth"))

        def below(c: Chains) -> pa.RecordBatch:
            here, at = c.within(parts)
            in_ = c.passes(here, node[at], depth[at])
            here, at = here[in_], at[in_]
            found, place = np.unique(at, return_inverse=True)
            sums = [np.zeros(len(found), np.int64) for _ in range(2)]
            for s, w in zip(sums, (c.leaf, c.saved), strict=True):
                np.add.at(s, place, w[here])
            return batch({"part": parts[found], "leaves": sums[0], "saved": sums[1]}, SUMS)

        sums = state.mapInArrow(each(below), ddl(SUMS)).groupBy("part").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).orderBy("part").toPandas()
        leaves, saved = sums["leaves"].to_numpy(), sums["saved"].to_numpy()

        def cut(c: Chains) -> pa.RecordBatch:
            here, at = c.within(parts)
            in_ = c.passes(here, node[at], depth[at])
            on = 2 * c.mass[here] > totals[at]
            c.leaves[here[on]] += leaves[at[on]]
            c.total_saved[here[on]] += saved[at[on]]
            c.mass[here[on]] -= mass[at[on]]
            under, k = here[in_], depth[at[in_]]
            c.part[under] = c.path[np.minimum(c.path_at[c.chain[under]] + k + 1, len(c.path) - 1)]
            middle_ = c.id[under] == node[at[in_]]
            c.part[under[middle_]] = -1
            return c.written()

        new = store(state.mapInArrow(each(cut), state.schema))
        drop_table(state)
        state = new


def roll_up(top: np.ndarray, parent: np.ndarray, depth: np.ndarray, mass: np.ndarray, weights: np.ndarray, sums: np.ndarray) -> None:
    """Split whole components at their centroids and add to ``sums`` (rows: nodes) what lies below each node.

    ``top`` is the place of the component's top, ``parent`` that of the parent, -1 if it is in no component here."""
    levels = [np.flatnonzero(depth == d) for d in np.unique(depth)]
    while (top >= 0).any():
        live = np.flatnonzero(top >= 0)
        on = live[2 * mass[live] > mass[top[live]]]
        on = on[np.argsort(mass[on], kind="stable")[::-1]]
        centre = np.full(len(top), -1)
        centre[top[on]] = on  # the last one written has the least mass
        mid = np.zeros(len(top), bool)
        mid[centre[centre >= 0]] = True
        under = np.full(len(top), -1)  # the child of the centroid that a node is at or below; its own place for the centroid
        for nodes in levels:
            p = parent[nodes]
            same = (p >= 0) & (top[nodes] >= 0) & (top[p] == top[nodes])
            up = np.where(same, under[p], -1)
            under[nodes] = np.where(mid[nodes], nodes, np.where(up < 0, -1, np.where(mid[p], nodes, up)))
        below = np.flatnonzero(under >= 0)
        found = np.zeros_like(sums)
        np.add.at(found, top[below], weights[below])
        sums[on] += found[top[on]]
        mass[on] -= mass[centre[top[on]]].copy()
        top[below] = under[below]
        top[mid] = -1


def roll_up_small(nodes: DataFrame) -> DataFrame:
    """The rest of the roll-up, on nodes dealt out by component."""
    out = pa.schema([(n, pa.int64()) for n in ("id", "leaves", "total_saved")])
    names = ["part", "id", "parent", "depth", "mass", "leaf", "saved", "leaves", "total_saved"]

    def of(held: list[np.ndarray]) -> pa.RecordBatch:
        part, id_, parent, depth, mass, leaf, saved, leaves, total = np.concatenate(held, axis=1)
        order = np.argsort(id_)

        def place(x: np.ndarray) -> np.ndarray:
            at = order[np.minimum(np.searchsorted(id_[order], x), len(id_) - 1)]
            return np.where(id_[at] == x, at, -1)

        up = place(parent)
        up = np.where((up >= 0) & (part[up] == part), up, -1)
        sums = np.stack([leaves, total], axis=1)
        roll_up(place(part), up, depth, mass.copy(), np.stack([leaf, saved], axis=1), sums)
        return batch({"id": id_, "leaves": sums[:, 0], "total_saved": sums[:, 1]}, out)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rb in it:
            rows = np.stack([rb.column(k).to_numpy() for k in range(len(names))])
            cuts = [0, *(np.flatnonzero(np.diff(rows[0])) + 1).tolist(), rows.shape[1]]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if n >= BATCH_ROWS and held[-1][0, -1] != rows[0, a]:
                    yield of(held)
                    held, n = [], 0
                if b > a:
                    held.append(rows[:, a:b])
                    n += b - a
        if held:
            yield of(held)

    n = merge_partitions(nodes.sparkSession)
    return nodes.select(names).repartition(n, "part").sortWithinPartitions("part").mapInArrow(run, ddl(out))


def prefix_trie(conversations: DataFrame, local_rows: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the
    trie of rebuilt conversations.

    ``conversations`` has conv_id, turn, role and text; other columns are not read. Rows with a null id are left out.
    Turns stand in order of ``turn``, null first, then by the digest of role and text, so repeated rows are turns of
    their own. A null role or text counts as empty. An empty table gives no rows. Texts enter as digests of 128 bits and
    their lengths, so very long ones are not moved; one conversation's digests are held by a task at a time.
    """
    rows = store(prefixes(conversations))
    n_rows = rows.count()
    local = local_rows or max(LOCAL_ROWS, n_rows // MOST)
    nodes = trie_nodes(rows)
    made = chains(rows, nodes, n_rows)
    root = nodes.where(F.col("node") == F.lit(b"\0" * 16)).select("id").first()
    zero = F.transform("mass", lambda _: F.lit(0).cast("bigint"))
    part = F.transform("mass", lambda _: F.lit(root[0] if root else 0).cast("bigint"))
    state = split_large(store(made.withColumns({"part": part, "leaves": zero, "total_saved": zero})), local)

    own = F.explode(F.arrays_zip("mass", "leaf", "saved", "part", "leaves", "total_saved", F.slice("path", F.col("first") + 1, F.size("path")).alias("id"), F.transform("mass", lambda _, i: F.col("first") + i).alias("depth"), F.slice(F.concat(F.array(F.lit(-1).cast("bigint")), "path"), F.col("first") + 1, F.size("mass")).alias("parent")))
    flat = state.select("conv_id", F.when(F.col("first") > 0, F.col("parent_conv_id")).alias("up"), "first", own.alias("n")).select("conv_id", "up", "first", "n.*")
    flat = store(flat)
    done = flat.where("part = -1").select("id", "leaves", "total_saved").union(roll_up_small(flat.where("part <> -1")))
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("first"), F.col("up")).otherwise(F.col("conv_id"))
    named = flat.select("conv_id", "depth", parent.cast("bigint").alias("parent_conv_id"), "id")
    out = named.join(done, "id").join(nodes.select("id", "n_convs", "n_children", "ends"), "id")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("total_saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS l FROM t GROUP BY conv_id
), h AS (
  SELECT conv_id, l, (4294967295 - list_reduce(list_prepend(4294967295, list_transform(range(0, 8 * length(CAST(conv_id AS VARCHAR))),
    lambda i: (ascii(CAST(conv_id AS VARCHAR)[i // 8 + 1]) >> CAST(i % 8 AS INT)) & 1)),
    lambda x, b: xor(x >> 1, CASE WHEN xor(x, b) & 1 = 1 THEN 3988292384 ELSE 0 END))) % 9 AS h FROM o
), b AS (
  SELECT h.conv_id, list_concat(coalesce(p.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN o p ON p.conv_id = h.conv_id - h.conv_id % 5
), m AS (
  SELECT conv_id, len(l) AS n, d, l[1:d] AS k FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM b)
), s AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(k[d].t) END AS saved FROM m GROUP BY k, d
), c AS (
  SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM s WHERE d > 0 GROUP BY ALL
), u AS (
  SELECT s.*, coalesce(c.n, 0) AS n_children FROM s LEFT JOIN c ON c.k = s.k AND c.d = s.d
), a AS (
  SELECT k[1:e] AS k, e AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT k, n_children, saved, unnest(range(0, d + 1)) AS e FROM u) GROUP BY k[1:e], e
)
SELECT u.conv_id, u.d AS depth, p.conv_id AS parent_conv_id, u.n_convs, CAST(u.n_children AS BIGINT) AS n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves,
  CAST(a.saved_tokens AS BIGINT) AS saved_tokens, u.ends_sha256
FROM u JOIN a ON a.k = u.k AND a.d = u.d LEFT JOIN s p ON p.d = u.d - 1 AND p.k = u.k[1:u.d - 1]
"""


@query("op11_prefix_trie", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
