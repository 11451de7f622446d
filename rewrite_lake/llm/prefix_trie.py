"""The prefix trie of conversations, from sorted neighbours.

A conversation is the sequence of its turns' digests.  Sequences are sorted over
the cluster; in each sorted run the depths that neighbours share (LCP) are the
edges of a union-find, taken in descending depth: a merge of components makes a
branching node, or joins a node of the same depth.  The chain between a node and
its parent holds the nodes with the same members.

Only the nodes on the first and the last sequence of a run can go on in another
run.  They leave the run as contracted partial nodes (counts that add up), and
are merged by the digest of their prefix; what two neighbouring runs both counted
is the shared prefix of their border, and is taken back.  So no node, however
many conversations share it, is put together in one task; only the checksum of a
node's ends streams through one, in pieces of joined ids.

A conversation itself is one row: 16 bytes and a length for each of its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, read

#: Bytes of a turn's digest; ids of one piece of a node's ends; nodes of one output batch.
WIDTH, PIECE, BATCH = 16, 20_000, 20_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = ("kind string, run int, key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, "
         "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, ends string, "
         "first binary, first_sizes array<int>, last binary, last_sizes array<int>")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def sequences(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq, sizes): per conversation its turns' digests joined, and the UTF-8 bytes of their texts.

    Turns go by number, null first; ties by role, then by digest.  Null roles and
    texts are empty, repeated turns stay.  Rows without an id belong to no
    conversation.  Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    slim = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).alias("size")).alias("t"))
    ordered = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return ordered.select("conv_id", F.unhex(F.array_join(F.col("ts.digest"), "")).alias("seq"), F.col("ts.size").alias("sizes"))


def shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with alike."""
    d, most = 0, min(len(a), len(b))
    while d < most and a[d:d + WIDTH] == b[d:d + WIDTH]:
        d += WIDTH
    return d // WIDTH


def prefix_keys(seq: bytes) -> list[bytes]:
    """The digest of each prefix, the empty one first."""
    keys = [b"\0" * WIDTH]
    for at in range(0, len(seq), WIDTH):
        keys.append(hashlib.blake2b(keys[-1] + seq[at:at + WIDTH], digest_size=WIDTH).digest())
    return keys


class _Node:
    __slots__ = ("depth", "lo", "hi", "least", "n", "leaves", "saved", "ends", "kids", "up")

    def __init__(self, depth: int, lo: int, hi: int, ends: list, kids: list):
        self.depth, self.lo, self.hi, self.ends, self.kids, self.up = depth, lo, hi, ends, kids, None


def branching(ids: list[int], seqs: list[bytes]) -> list[_Node]:
    """Branching and ending nodes of a sorted run, deepest first: union-find over
    the neighbours' shared depths, descending."""
    n = len(ids)
    lcp = [shared(seqs[i - 1], seqs[i]) for i in range(1, n)]
    boss = list(range(n))
    top = [_Node(len(s) // WIDTH, i, i, [i], []) for i, s in enumerate(seqs)]

    def find(i: int) -> int:
        while boss[i] != i:
            boss[i] = boss[boss[i]]
            i = boss[i]
        return i
    for i in sorted(range(n - 1), key=lambda i: -lcp[i]):
        a, b, depth = find(i), find(i + 1), lcp[i]
        u, v = top[a], top[b]
        if u.depth == depth == v.depth:
            if len(u.ends) + len(u.kids) < len(v.ends) + len(v.kids):  # the smaller is moved
                u, v = v, u
            u.ends += v.ends
            u.kids += v.kids
            node = u
        elif u.depth == depth:
            u.kids.append(v)
            node = u
        elif v.depth == depth:
            v.kids.append(u)
            node = v
        else:
            node = _Node(depth, 0, 0, [], [u, v])
        node.lo, node.hi = min(u.lo, v.lo), max(u.hi, v.hi)
        boss[b] = a
        top[a] = node
    nodes, stack = [], [top[find(0)]] if n else []
    while stack:
        node = stack.pop()
        nodes.append(node)
        for kid in node.kids:
            kid.up = node
        stack += node.kids
    return nodes[::-1]  # every node after its children


def run_rows(run: int, ids: list[int], seqs: list[bytes], sizes: list[list[int]]) -> Iterator[dict]:
    """All nodes of one sorted run: closed ones, and partial ones of its two borders."""
    n = len(ids)
    first, last = prefix_keys(seqs[0]), prefix_keys(seqs[-1])
    for node in branching(ids, seqs):
        above, size = node.up.depth if node.up else -1, sizes[node.lo]
        node.ends.sort()
        node.n = len(node.ends) + sum(k.n for k in node.kids)
        node.least = min([ids[i] for i in node.ends[:1]] + [k.least for k in node.kids])
        node.leaves = sum(k.leaves for k in node.kids) or 1
        saved = sum(k.saved for k in node.kids)
        chain = []
        for depth in range(node.depth, above, -1):  # up to the parent's child
            saved += (node.n - 1) * (size[depth - 1] if depth else 0)
            chain.append((depth, saved))
        node.saved = saved
        keys = first if node.lo == 0 else last if node.hi == n - 1 else None
        for depth, saved in chain:
            at_node = depth == node.depth
            row = {"conv_id": node.least, "depth": depth, "n_convs": node.n, "n_leaves": node.leaves, "saved_tokens": saved,
                   "n_children": len(node.kids) if at_node else 1}
            ends = [str(ids[i]) for i in node.ends] if at_node else []
            if keys is not None:
                row |= {"kind": "open", "run": run, "key": keys[depth], "parent_key": keys[depth - 1] if depth else None}
                yield row
                for at in range(0, len(ends), PIECE):
                    yield {"kind": "ends", "run": run, "key": keys[depth], "depth": at, "ends": ",".join(ends[at:at + PIECE])}
                continue
            if ends:
                row["ends_sha256"] = hashlib.sha256(",".join(ends).encode()).hexdigest()
            if depth > above + 1:
                yield row | {"kind": "node", "parent_conv_id": node.least}
            else:  # its parent's least id is known when the whole run is
                yield row | {"kind": "child", "up": node.up}
    yield {"kind": "border", "run": run, "first": seqs[0], "first_sizes": sizes[0], "last": seqs[-1], "last_sizes": sizes[-1]}


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    ids, seqs, sizes = [], [], []
    for b in batches:
        ids += b.column(0).to_pylist()
        seqs += b.column(1).to_pylist()
        sizes += b.column(2).to_pylist()
    if not ids:
        return
    run, schema, rows, waiting = TaskContext.get().partitionId(), _arrow(_NODE), [], []
    first, last = prefix_keys(seqs[0]), prefix_keys(seqs[-1])

    def settled(row):
        up = row.pop("up")
        keys = first if up.lo == 0 else last if up.hi == len(ids) - 1 else None
        if keys is None:
            return row | {"kind": "node", "parent_conv_id": up.least}
        return row | {"kind": "stem", "run": run, "parent_key": keys[up.depth]}
    for row in run_rows(run, ids, seqs, sizes):
        (waiting if row["kind"] == "child" else rows).append(row)
        if len(rows) >= BATCH:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
    for at in range(0, len(waiting), BATCH):
        yield pa.RecordBatch.from_pylist([settled(r) for r in waiting[at:at + BATCH]], schema=schema)
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two neighbouring runs both counted: the nodes of their border's shared prefix."""
    schema = _arrow("key binary, n_children bigint, n_leaves bigint, saved_tokens bigint")
    for b in batches:
        for r in b.to_pylist():
            depth = shared(r["before"], r["first"])
            ends = len(r["before"]) == depth * WIDTH  # the sequence before goes on, or is repeated: no leaf there
            saved, rows = 0, []
            for d, key in reversed(list(enumerate(prefix_keys(r["first"][:depth * WIDTH])))):
                saved += r["first_sizes"][d - 1] if d else 0
                rows.append({"key": key, "n_children": -int(d < depth), "n_leaves": -int(ends), "saved_tokens": saved})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over a node's pieces, which come sorted by (key, run, place)."""
    schema = _arrow("key binary, ends_sha256 string")
    key = state = None
    for b in batches:
        for k, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": state.hexdigest()}], schema=schema)
                key, state = k, hashlib.sha256()
                state.update(piece.encode())
            else:
                state.update(b"," + piece.encode())
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": state.hexdigest()}], schema=schema)


def prefix_trie(seqs: DataFrame, *, runs: int | None = None) -> DataFrame:
    """One row per node of the trie of ``seqs`` (conv_id, seq, sizes).

    Repeated conversations are members of the same nodes, each counted (rows that
    repeat an id too, the id then stands in a node's ends as often).  A sequence
    without turns is a member of the root alone.  No rows give no node.  ``runs``
    sets the number of sorted runs (default: adaptive).
    """
    by = ["seq", "conv_id"]
    dealt = seqs.select("conv_id", "seq", "sizes")
    dealt = dealt.repartitionByRange(runs, *by) if runs else dealt.repartitionByRange(*by)
    parts = materialize(dealt.sortWithinPartitions(*by).mapInArrow(_forest, _NODE), "trie-runs")
    opened = parts.where("kind = 'open'")
    # one row per run: its border with the run before it
    border = parts.where("kind = 'border'").select(
        "run", "first", "first_sizes", F.lag("last").over(Window.orderBy("run")).alias("before")).where("before is not null")
    twice = border.select("before", "first", "first_sizes").mapInArrow(
        _overlaps, "key binary, n_children bigint, n_leaves bigint, saved_tokens bigint")
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    names = ["key", "parent_key", "conv_id", "depth", *counts]
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("parent_key", "binary"), ("conv_id", "long"), ("depth", "long"), ("n_convs", "long"))]
    merged = opened.select(*names).union(twice.select("key", *nothing, *counts[1:]))
    merged = merged.groupBy("key").agg(F.first("parent_key", ignorenulls=True).alias("parent_key"), F.min("conv_id").alias("conv_id"),
                                       F.min("depth").alias("depth"), *[F.sum(c).alias(c) for c in counts])
    merged = materialize(merged, "trie-borders")
    pieces = parts.where("kind = 'ends'").select("key", "ends", "run", "depth")
    ends = pieces.repartition("key").sortWithinPartitions("key", "run", "depth").select("key", "ends").mapInArrow(
        _checksums, "key binary, ends_sha256 string")
    known = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    borders = merged.join(known, "parent_key", "left").join(ends, "key", "left")
    # a run's stems ask for its own copy of an open parent, so a parent of many children is spread over the runs
    near = opened.select("run", F.col("key").alias("parent_key")).distinct().join(known, "parent_key")
    stems = parts.where("kind = 'stem'").drop("parent_conv_id").join(near, ["run", "parent_key"])
    out = ["conv_id", "depth", "parent_conv_id", *counts]
    whole = parts.where("kind = 'node'").select(*out, "ends_sha256").union(stems.select(*out, "ends_sha256")).union(borders.select(*out, "ends_sha256"))
    return whole.select(*out, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def _mod(conv: Column, n: int) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % n


def with_shared_heads(seqs: DataFrame, *, group: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation with the first crc32(id) % ``heads`` turns of its group's first one in place of its own.

    A group is ``group`` ids from a multiple of it on; a missing first
    conversation gives no turns."""
    h = _mod(F.col("conv_id"), heads).cast("int")
    most = heads - 1
    base = seqs.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.substring("seq", 1, most * WIDTH).alias("head"), F.slice("sizes", 1, most).alias("head_sizes"))
    both = seqs.withColumn("h", h).join(base, F.col("conv_id") - F.col("conv_id") % group == F.col("base"), "left")
    rest = F.substring("seq", F.col("h") * WIDTH + 1, F.lit(2**31 - 1))
    seq = F.concat(F.coalesce(F.substring("head", F.lit(1), F.col("h") * WIDTH), F.lit(b"")), rest)
    sizes = F.concat(F.coalesce(F.slice("head_sizes", F.lit(1), F.col("h")), F.array().cast("array<int>")),
                     F.slice("sizes", F.col("h") + 1, F.size("sizes")))
    return both.select("conv_id", seq.alias("seq"), sizes.alias("sizes"))


def op12_prefix_trie(spark, sf_dir):
    seqs = materialize(sequences(read(spark, sf_dir, "conversations")), "trie-sequences")
    return prefix_trie(materialize(with_shared_heads(seqs), "trie-rebuilt"))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLE = {"op12_prefix_trie": r"""
with o as (
  select conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
    order by turn nulls first, coalesce(role, ''), md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as t
  from conversations where conv_id is not null group by conv_id),
h as (
  select conv_id, t, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::bigint for i in range(8)]),
      lambda v, z: xor(v >> 1, (v & 1) * 3988292384::bigint))), 4294967295::bigint) % 9 as h from o),
r as (
  select c.conv_id, list_concat(coalesce(b.t[1:c.h], []), c.t[c.h + 1:]) as t
  from h c left join o b on b.conv_id = c.conv_id - c.conv_id % 5),
p as (select conv_id, d, t[1:d] as p, len(t) = d as last from r, unnest(range(0, len(t) + 1)) as u(d)),
n as (
  select p, d, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '')) as ends_sha256
  from p group by p, d),
k as (select n.*, coalesce(c.n_children, 0) as n_children,
    case when d = 0 then 0 else (n_convs - 1) * strlen(p[d].text) end as saved
  from n left join (select p[1:d - 1] as up, count(*) as n_children from n where d > 0 group by 1) c on c.up = n.p),
s as (
  select p[1:a] as p, sum(case when n_children = 0 then 1 else 0 end)::bigint as n_leaves, sum(saved)::bigint as saved_tokens
  from k, unnest(range(0, d + 1)) as u(a) group by 1)
select k.conv_id, k.d as depth, up.conv_id as parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
from k join s on s.p = k.p left join n up on k.d > 0 and up.p = k.p[1:k.d - 1]
"""}
