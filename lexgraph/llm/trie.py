"""Operator 12, conversation prefix trie: distributed MSD radix partitioning, finished by multikey quicksort.

A node is a distinct sequence of a conversation's first ``d`` turns. Turns are dictionary-encoded first: texts are read once, and from then on a turn is an id and a length.

1. Turns are numbered by :func:`lexgraph.llm.chat.numbered`, which sorts a conversation of any size in ranges. Only texts of turns that tie in number and
   role are carried into that sort.
2. All conversations are one bucket, the root. In each round, buckets that aren't local are dealt by the next turn's id; counting a bucket is a hash aggregate, so a first turn
   or a copy that most conversations share costs one row per task. A bucket is a node.
3. A bucket of one conversation is a path: its nodes are the conversation's remaining turns, made by a projection. A bucket of at most ``local_rows`` conversations and
   ``local_turns`` remaining turns goes to one task, which splits it by multikey quicksort and emits nodes while it returns. Others recurse.
4. The nodes of step 2 take the sums of their subtrees from below, round by round.

The ids of conversations that end at a node are digested in ascending order: in step 3 inside the task, in step 2 by a stream over sorted strings of a bounded range of ids each, so
a node at which most conversations end takes no more memory.

Rounds follow the depth to which more than ``local_rows`` conversations share all turns; each shuffles ids only.

Defined results: a null role or text is empty; turns are ordered by turn (null first), then role, then text; repeated rows are turns of their own; rows with a null conv_id belong to
no conversation; a conversation whose rebuilt form has no turn belongs to the root; an empty table has no nodes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat import numbered
from .tables import cut, with_workers

LOCAL_ROWS = 2048
LOCAL_TURNS = 1 << 19
PART_TURNS = 4096
#: Width of the range of ids whose digits are joined to one string.
ID_RANGE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_LOCAL = NODE + ", bucket long"


def encoded(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), sym (the id of role and text), chars (code points of the text) of every turn."""
    text = F.coalesce(turns[text_col].cast("string"), F.lit(""))
    who = F.coalesce(turns[role_col].cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, text).cast("binary"), 256))
    rows = turns.where(turns[conv_col].isNotNull()).select(turns[conv_col].cast("long").alias("conv_id"), turns[turn_col].cast("long").alias("turn"), who.alias("who"), text.alias("text"), key.alias("key"), F.char_length(text).cast("long").alias("chars"))
    at = ["conv_id", "turn", "who"]
    ties = cut(rows.groupBy(*at).agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select(*[F.col(c).alias(f"tie_{c}") for c in at]), "trie-ties")
    same = [rows[c].eqNullSafe(ties[f"tie_{c}"]) for c in at]
    narrow = rows.join(ties, same, "left").select(*at, F.when(F.col("tie_who").isNotNull(), rows["text"]).alias("text"), "key", "chars")
    placed = cut(numbered(narrow, PART_TURNS).select("conv_id", (F.col("number") + 1).alias("pos"), "key", "chars"), "trie-turns")
    names = cut(placed.select("key").distinct().select("key", F.monotonically_increasing_id().alias("sym")), "trie-dictionary")
    return cut(placed.join(names, "key").select("conv_id", "pos", "sym", "chars"), "trie-encoded")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after each conversation c takes the first ``h`` turns of conversation ``c - c % group``, h = crc32(c) % ``most``.

    ``turns`` as :func:`encoded` gives them. conversations: conv_id, len; turns: conv_id, pos, sym, chars.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", "own", base.alias("base"), h.alias("h"))
    heads = turns.where((F.col("pos") < most) & (F.col("conv_id") % group == 0))
    lent = heads.groupBy("conv_id").agg(F.count("*").alias("m")).select(F.col("conv_id").alias("base"), "m")
    plan = cut(own.join(lent, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("m", F.lit(0))).alias("lent"), "own"), "trie-plan")
    first = plan.select("conv_id", "base", "lent").join(heads.withColumnRenamed("conv_id", "base"), "base").where(F.col("pos") <= F.col("lent")).select("conv_id", "pos", "sym", "chars")
    # h and lent are the same for all turns of a conversation, but lent needs its row of the plan
    rest = turns.where(F.col("pos") > h).join(plan.select("conv_id", "h", "lent"), "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "sym", "chars")
    lengths = plan.select("conv_id", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("len"))
    return lengths, cut(first.union(rest), "trie-rebuilt")


@dataclass
class Sequence:
    """A conversation from its bucket's node on: ids and text lengths of its remaining turns."""

    conv: int
    syms: list[int]
    chars: list[int]


def split(rows: list[int], seqs: list[Sequence], at: int) -> list[list[int]]:
    """``rows`` by their symbol at ``at``, ascending: three-way partitioning by the middle row's symbol, smaller and larger parts again."""
    out: list[list[int]] = []
    todo: list[tuple[list[int], bool]] = [(rows, False)]
    while todo:
        part, equal = todo.pop()
        if equal or len(part) == 1:
            out.append(part)
            continue
        pivot = seqs[part[len(part) // 2]].syms[at]
        less, same, more = [], [], []
        for r in part:
            s = seqs[r].syms[at]
            (same if s == pivot else less if s < pivot else more).append(r)
        todo += [x for x in ((more, False), (same, True), (less, False)) if x[0]]
    return out


def ids_hash(convs: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(convs))).encode()).hexdigest() if convs else EMPTY


def nodes(seqs: list[Sequence], depth: int, parent: int | None, top_chars: int) -> list[tuple]:
    """All nodes of the trie below (and of) the node at ``depth`` that all ``seqs`` share; the last row is that node.

    The stack holds open nodes; a node is emitted when its children have been, so its sums are complete.
    """
    out: list[tuple] = []

    class Open:
        __slots__ = ("at", "chars", "children", "conv", "ends", "leaves", "parent", "parts", "rows", "saved", "up")

        def __init__(self, rows: list[int], at: int, parent: int | None, chars: int, up: Open | None):
            self.rows, self.at, self.parent, self.up = rows, at, parent, up
            self.conv = min(seqs[r].conv for r in rows)
            self.ends = [seqs[r].conv for r in rows if len(seqs[r].syms) == at]
            going = [r for r in rows if len(seqs[r].syms) > at]
            self.parts = split(going, seqs, at) if going else []
            self.children = len(self.parts)
            self.leaves = 0 if self.parts else 1
            self.saved = (len(rows) - 1) * chars

    stack = [Open(list(range(len(seqs))), 0, parent, top_chars, None)]
    while stack:
        node = stack[-1]
        if node.parts:
            part = node.parts.pop()
            if len(part) == 1:  # a path
                seq = seqs[part[0]]
                last = len(seq.syms)
                for at in range(last, node.at, -1):
                    out.append((seq.conv, depth + at, seq.conv if at > node.at + 1 else node.conv, 1, int(at < last), 1, 0, ids_hash([seq.conv]) if at == last else EMPTY))
                node.leaves += 1
                continue
            stack.append(Open(part, node.at + 1, node.conv, seqs[part[0]].chars[node.at], node))
            continue
        stack.pop()
        out.append((node.conv, depth + node.at, node.parent, len(node.rows), node.children, node.leaves, node.saved, ids_hash(node.ends)))
        if node.up is not None:
            node.up.leaves += node.leaves
            node.up.saved += node.saved
    return out


def _finish(rows: DataFrame) -> DataFrame:
    """Nodes of local buckets, the node of the bucket itself with its id. rows: depth, bucket, parent, conv_id, pos (null where a conversation has no turn left), sym, chars; the turn at ``depth`` itself is included if depth > 0."""
    types = [pa.int64()] * 7 + [pa.string(), pa.int64()]
    names = [x.split()[0] for x in _LOCAL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, depth, parent, top, seqs = None, 0, None, 0, []
        made: list[tuple] = []

        def close() -> None:
            found = nodes(seqs, depth, parent, top)
            made.extend((*x, None) for x in found[:-1])
            made.append((*found[-1], now[1]))

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)
            made.clear()
            return out

        for batch in batches:
            for d, bucket, up, conv, pos, sym, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, bucket) != now:
                    if seqs:
                        close()
                    now, depth, parent, top, seqs = (d, bucket), d, up, 0, []
                if not seqs or seqs[-1].conv != conv:
                    seqs.append(Sequence(conv, [], []))
                if pos is not None and pos > d:
                    seqs[-1].syms.append(sym)
                    seqs[-1].chars.append(chars)
                elif pos is not None:
                    top = chars
                if len(made) >= 20_000:
                    yield batch_of()
        if seqs:
            close()
        if made:
            yield batch_of()

    dealt = rows.select("depth", "bucket", "parent", "conv_id", "pos", "sym", "chars").repartition("depth", "bucket").sortWithinPartitions("depth", "bucket", "conv_id", "pos")
    return dealt.mapInArrow(run, _LOCAL)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """bucket, ends_sha256 of (bucket, conv_id): ids of a range are joined by an aggregate, then a stream over the sorted ranges feeds one digest per bucket."""
    part = F.floor(F.col("conv_id") / ID_RANGE)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    strings = ends.groupBy("bucket", part.alias("part")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []
        for batch in batches:
            for bucket, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = bucket, hashlib.sha256()
                    digest.update(ids.encode())
                else:
                    digest.update(("," + ids).encode())
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done])], names=["bucket", "ends_sha256"])
                done = []
        if digest is not None:
            done.append((now, digest.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done])], names=["bucket", "ends_sha256"])

    dealt = strings.repartition("bucket").sortWithinPartitions("bucket", "part").select("bucket", "ids")
    return dealt.mapInArrow(run, "bucket long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, turns: DataFrame, local_rows: int = LOCAL_ROWS, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """Nodes of the trie. conversations: conv_id, len (0 for those without turns); turns: conv_id, pos (1 to len), sym, chars."""
    spark = with_workers(conversations.sparkSession)
    is_local = (F.col("n") <= local_rows) & (F.col("turns") <= local_turns)

    # the root bucket; a bucket's id is unique in its round, whose number is the depth
    top = conversations.agg(F.count("*").alias("n"), F.sum("len").alias("turns"), F.min("conv_id").alias("low")).withColumn("kind", F.when(is_local, "local").otherwise("big")).first()
    if not top["n"]:
        return spark.createDataFrame([], NODE)
    stats = spark.createDataFrame([(None, 0, top["n"], top["turns"], top["low"], None, 0, top["kind"])], "up long, bucket long, n long, turns long, low long, up_low long, chars long, kind string")
    members = conversations.select("conv_id", "len", F.lit(0).cast("long").alias("bucket"), F.lit(top["kind"]).alias("kind"), F.lit(None).cast("long").alias("up_low"))
    depth, rounds, settled = 0, [], []
    while True:
        members = cut(members, "trie-members")
        settled.append(members.where("kind <> 'big'").withColumn("depth", F.lit(depth).cast("long")))
        ends = members.where((F.col("kind") == "big") & (F.col("len") == depth)).select("bucket", "conv_id")
        going = members.where((F.col("kind") == "big") & (F.col("len") > depth)).select("conv_id", "len", F.col("bucket").alias("up"))
        rounds.append((depth, stats, ends))
        if going.isEmpty():
            break
        step = cut(going.join(turns.where(F.col("pos") == depth + 1).select("conv_id", "sym", "chars"), "conv_id"), "trie-step")
        found = step.groupBy("up", "sym").agg(F.count("*").alias("n"), F.sum(F.col("len") - depth - 1).alias("turns"), F.min("conv_id").alias("low"), F.max("chars").alias("chars"))
        kind = F.when(F.col("n") == 1, "path").when(is_local, "local").otherwise("big")
        above = stats.where("kind = 'big'").select(F.col("bucket").alias("up"), F.col("low").alias("up_low"))
        new = cut(found.join(above, "up").withColumn("kind", kind).withColumn("bucket", F.monotonically_increasing_id()), "trie-buckets")
        members = step.join(new.select("up", "sym", "bucket", "kind", "up_low"), ["up", "sym"]).select("conv_id", "len", "bucket", "kind", "up_low")
        stats = new.select("up", "bucket", "n", "turns", "low", "up_low", "chars", "kind")
        depth += 1

    placed = settled[0]
    for more in settled[1:]:
        placed = placed.unionByName(more)
    end = F.when(F.col("pos") == F.col("len"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(EMPTY)
    lone = placed.where("kind = 'path'").join(turns.select("conv_id", "pos"), "conv_id").where("pos >= depth")
    one = F.lit(1).cast("long")
    paths = lone.select(
        "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("depth"), F.col("up_low")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        (F.col("pos") < F.col("len")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), end.alias("ends_sha256"),
    )
    held = placed.where("kind = 'local'").select("conv_id", "bucket", "depth", F.col("up_low").alias("parent"))
    turn = turns.select(F.col("conv_id").alias("c"), "pos", "sym", "chars")
    local = cut(_finish(held.join(turn, (held["conv_id"] == turn["c"]) & (turn["pos"] >= held["depth"]), "left")), "trie-local")

    # upward: what the buckets of each round add to the round before
    below = local.where("bucket is not null").select("depth", "bucket", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    up, big = None, []
    for at, table, ends in reversed(rounds):
        mine = table.where("kind = 'big'").select("bucket", "n", "low", "up", "up_low", "chars")
        if up is None:
            full = mine.withColumns({"children": F.lit(0).cast("long"), "leaves": one, "saved": (F.col("n") - 1) * F.col("chars")})
        else:
            full = mine.join(up, "bucket", "left").select(*mine.columns, F.coalesce("n_below", F.lit(0)).alias("children"), F.coalesce("leaves_below", one).alias("leaves"), ((F.col("n") - 1) * F.col("chars") + F.coalesce("saved_below", F.lit(0))).alias("saved"))
        full = cut(full, "trie-nodes")
        hashes = _end_hashes(ends)
        big.append(full.join(hashes, "bucket", "left").select(F.col("low").alias("conv_id"), F.lit(at).cast("long").alias("depth"), F.col("up_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))
        # paths have one leaf and save nothing
        sums = full.select("bucket", "leaves", "saved").union(below.where(F.col("depth") == at).drop("depth"))
        rest = table.where("up is not null").join(sums, "bucket", "left").select("up", F.coalesce("leaves", one).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
        up = rest.groupBy(F.col("up").alias("bucket")).agg(F.count("*").alias("n_below"), F.sum("leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))
    out = paths.union(local.drop("bucket"))
    for nodes_ in big:
        out = out.union(nodes_)
    return out


def query(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(*rebuilt(encoded(conversations)))


SQL = f"""
WITH conv AS (
  SELECT conv_id, list(md5(coalesce(role, '')) || md5(coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS e,
    list(length(coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.e, [])[1:c.h], c.e[c.h + 1:]) AS e, list_concat(coalesce(b.n, [])[1:c.h], c.n[c.h + 1:]) AS n FROM conv c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 100),
step AS (SELECT conv_id, d, len(e) AS l, coalesce(array_to_string(e[1:d], ''), '') AS k, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS chars FROM built, unnest(generate_series(0, len(e))) AS g(d)),
node AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE l = d), '')) AS ends FROM step GROUP BY k, d),
child AS (SELECT left(k, 64 * (d - 1)) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
tree AS (SELECT left(x.k, 64 * i) AS k, sum((x.n - 1) * x.chars) AS saved, count(*) FILTER (WHERE child.n IS NULL) AS leaves FROM node x LEFT JOIN child ON child.k = x.k, unnest(generate_series(0, x.d)) AS g(i) GROUP BY 1)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n AS n_convs, coalesce(child.n, 0) AS n_children, CAST(tree.leaves AS BIGINT) AS n_leaves, CAST(tree.saved AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM node a JOIN tree ON tree.k = a.k LEFT JOIN child ON child.k = a.k LEFT JOIN node p ON a.d > 0 AND p.k = left(a.k, 64 * (a.d - 1))"""
