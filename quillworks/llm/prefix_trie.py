"""Prefix trie of conversations: members, children, leaves and savings of every shared beginning.

A node is a distinct sequence of first turns; the root is the empty one. The trie is never whole in one place:

* A conversation is a row: 16 bytes of hash and a length per turn, its path. Rows are range-partitioned by path and
  conv_id, so the conversations below any node are neighbours, and equal conversations, however many, are cut by
  conv_id.
* A task reads its sorted rows in blocks and encodes the trie of a block as balanced parentheses, in preorder. The
  excess (open minus closed so far) is kept with its minima over blocks of doubling size; ``find_close`` climbs and
  descends them to the closing parenthesis of each node, which delimits its subtree. The rank of ``()`` pairs
  counts leaves, cumulative arrays in preorder give members and savings.
* Nodes on the first and the last path of a block, its spines, may go on in the neighbours. What hangs on them
  (members, leaves, savings and number of the finished subtrees, smallest member) is added up per spine node and carried into
  the next block of the task as a weighted path. At the end of a task its two spines are left. Spines of ``FAN_IN``
  tasks are merged by the same code, until one group is left; that closes the root.
* The identifiers of members that end at a spine node travel as chunks and are hashed in order, a chunk at a time.

Turns are ordered by ``turn``, null first; ties by role, then by the first 16 bytes of the turn's SHA-256. A null role or text is empty. Equal
hashes of (role, text) stand for equal turns.

Defined cases: rows without a conv_id belong to no conversation and are left out; repeated rows are turns like
others; an empty table has no node; columns besides conv_id, turn, role and text are not read. A conversation
is one row of 24 bytes a turn, and a block holds at least ``LEAST_ITEMS`` of them, however long they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillworks.llm.common import staged

#: Turns and conversations of a block.
BLOCK_TURNS, LEAST_ITEMS = 100_000, 16
#: Identifiers of a chunk, and spines of so many tasks that are merged together.
CHUNK_IDS, FAN_IN = 4096, 256
KEY_BYTES = 16
NODE, CHUNK, SPINE = 0, 1, 2
NO_CONV = np.iinfo(np.int64).max
HANGING = ("convs", "least", "leaves", "saved", "children", "split")

ROWS = (
    "kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long,"
    " n_children long, n_leaves long, saved_tokens long, ends_sha256 string, seq long, path binary, lens binary, hang binary"
)
_TYPES = {
    "kind": pa.int32(),
    "key": pa.binary(),
    "parent_key": pa.binary(),
    "conv_id": pa.int64(),
    "depth": pa.int64(),
    "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(),
    "n_children": pa.int64(),
    "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(),
    "ends_sha256": pa.string(),
    "seq": pa.int64(),
    "path": pa.binary(),
    "lens": pa.binary(),
    "hang": pa.binary(),
}
RESULT = [
    "conv_id",
    "depth",
    "parent_conv_id",
    "n_convs",
    "n_children",
    "n_leaves",
    "saved_tokens",
    "ends_sha256",
]


class Excess:
    """Balanced parentheses with the minima of their excess over blocks of 1, 2, 4, … positions."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        excess = np.cumsum(np.where(opens, 1, -1)).astype(np.int32)
        size = 1 << max(1, len(excess) - 1).bit_length()
        never = np.iinfo(np.int32).max
        self.least = [np.concatenate([excess, np.full(size - len(excess), never, dtype=np.int32)])]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(axis=1))
        pair = np.zeros(len(opens) + 1, dtype=np.int64)
        np.cumsum(opens & ~np.append(opens[1:], False), out=pair[1:])
        self._pairs = pair

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each open one: the first later place with an excess below its own."""
        target = self.least[0][at] - 1
        node, level = at.copy(), np.full(len(at), -1)
        climbing = np.arange(len(at))
        for height, least in enumerate(self.least[:-1]):
            left = climbing[node[climbing] & 1 == 0]
            done = left[least[node[left] + 1] <= target[left]]
            node[done] += 1
            level[done] = height
            climbing = climbing[level[climbing] < 0]
            node[climbing] >>= 1
        for height in range(len(self.least) - 1, 0, -1):
            going = np.flatnonzero(level >= height)
            child = node[going] * 2
            node[going] = child + (self.least[height - 1][child] > target[going])
        return node

    def leaf_rank(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of ``()`` from begin to end, both included."""
        return self._pairs[end] - self._pairs[begin]


def range_minimum(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of ``values[begin:end]`` for each pair, none of them empty."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    height = np.frexp((end - begin).astype(np.float64))[1] - 1
    found = np.empty(len(begin), dtype=values.dtype)
    for h, level in enumerate(table):
        own = np.flatnonzero(height == h)
        found[own] = np.minimum(level[begin[own]], level[end[own] - (1 << h)])
    return found


class Spine:
    """A path with what hangs on each of its nodes, the root first."""

    def __init__(self, keys: np.ndarray, lens: np.ndarray, hang: np.ndarray):
        self.keys, self.lens, self.hang = keys, lens, hang

    def names(self) -> list[bytes]:
        """Of each node: a digest of the path down to it."""
        digest, names = hashlib.blake2b(digest_size=KEY_BYTES), []
        names.append(digest.digest())
        for key in self.keys:
            digest.update(key.tobytes())
            names.append(digest.digest())
        return names


class Rows:
    """Result rows on their way out."""

    def __init__(self):
        self.rows: list[dict] = []

    def add(self, **row) -> None:
        self.rows.append(row)

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        while len(self.rows) >= least:
            part, self.rows = self.rows[:20_000], self.rows[20_000:]
            columns = [pa.array([r.get(name) for r in part], kind) for name, kind in _TYPES.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[*_TYPES])


class Block:
    """The trie of consecutive paths: spines carried so far, then conversations."""

    def __init__(self, spines: list[Spine], keys: np.ndarray, lens: np.ndarray, sizes: np.ndarray, convs: np.ndarray):
        self.spines, self.convs = spines, convs
        self.keys = np.concatenate([*(s.keys for s in spines), keys])
        self.lens = np.concatenate([*(s.lens for s in spines), lens])
        self.sizes = np.concatenate([[len(s.keys) for s in spines], sizes]).astype(np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self._build()

    def _common(self) -> np.ndarray:
        """Turns that each path shares with the one before it."""
        shared = np.zeros(len(self.sizes), dtype=np.int64)
        reach = np.minimum(self.sizes[1:], self.sizes[:-1])
        which = np.repeat(np.arange(len(reach)), reach)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(reach) - reach, reach)
        same = (self.keys[self.begin[which] + turn] == self.keys[self.begin[which + 1] + turn]).all(axis=1)
        shared[1:] = reach
        differ = np.flatnonzero(~same)
        np.minimum.at(shared, which[differ] + 1, turn[differ])
        return shared

    def _build(self) -> None:
        common = self._common()
        new = self.sizes - common
        path = np.repeat(np.arange(len(new)), new)
        depth = np.arange(len(path)) - np.repeat(np.cumsum(new) - new, new) + common[path] + 1
        self.depth = np.concatenate([[0], depth])
        self.length = np.concatenate([[0], self.lens[self.begin[path] + depth - 1]])
        #: Newest node when a path has been read, and for each depth the newest node of it.
        self.newest = np.cumsum(new)
        self.stride = len(self.depth) + 1
        self.by_depth = np.sort(self.depth * self.stride + np.arange(len(self.depth)))
        # Before the nodes of a path, those that it does not share are closed.
        closed = np.append(self.sizes[:-1] - common[1:], self.sizes[-1] + 1)
        turns = np.empty(2 * len(new) + 1, dtype=np.int64)
        turns[0], turns[1::2], turns[2::2] = 1, new, closed
        opens = np.repeat(np.arange(len(turns)) % 2 == 1, turns)
        opens[0] = True
        self.parens = Excess(opens)
        self.open_at = np.flatnonzero(opens)
        self.close_at = self.parens.find_close(self.open_at)
        self.after = np.arange(len(self.depth)) + (self.close_at - self.open_at + 1) // 2
        self.parent = self.node_of(np.arange(len(self.depth)), self.depth - 1)

    def node_of(self, newest: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last node of a depth up to the node ``newest``; -1 above the root."""
        at = np.searchsorted(self.by_depth, depth * self.stride + newest, side="right") - 1
        return np.where(depth < 0, -1, self.by_depth[at] % self.stride)

    def path_nodes(self, path: int) -> np.ndarray:
        depth = np.arange(self.sizes[path] + 1)
        return self.node_of(np.full(len(depth), self.newest[path]), depth)

    def solve(self, sequence: int, whole: bool, rows: Rows) -> list[Spine]:
        """Hand finished nodes to ``rows`` and return the spines; if ``whole``, all nodes are finished."""
        size = len(self.depth)
        hang = np.zeros((len(HANGING), size), dtype=np.int64)
        hang[1] = NO_CONV
        for path, spine in enumerate(self.spines):
            at = self.path_nodes(path)
            hang[1, at] = np.minimum(hang[1, at], spine.hang[1])
            for i in (0, 2, 3, 4):
                hang[i, at] += spine.hang[i]
            hang[5, at] |= spine.hang[5]
        first_conv = len(self.spines)
        ends_at = self.node_of(self.newest[first_conv:], self.sizes[first_conv:])
        np.add.at(hang[0], ends_at, 1)
        np.minimum.at(hang[1], ends_at, self.convs)

        def below(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[self.after] - total[:-1]

        n_convs = below(hang[0])
        least = range_minimum(hang[1], np.arange(size), self.after)
        childless = self.after == np.arange(size) + 1
        # A node whose children are all finished is no leaf, though it is a pair here.
        bare = childless & (hang[4] > 0)
        n_leaves = self.parens.leaf_rank(self.open_at, self.close_at) - below(bare) + below(hang[2])
        saved = below((n_convs - 1) * self.length + hang[3])
        n_children = hang[4] + np.bincount(self.parent[1:], minlength=size)

        names: dict[int, bytes] = {}
        chains = [0, len(self.sizes) - 1]
        on_spine = np.zeros(size, dtype=bool)
        for path in {*chains, *range(first_conv)}:
            # Nodes that are or were on a spine go by a name that other tasks know.
            nodes = self.path_nodes(path)
            whole_path = self.keys[self.begin[path] : self.begin[path] + self.sizes[path]]
            names.update(zip(nodes.tolist(), Spine(whole_path, None, None).names(), strict=True))
        if not whole:
            for path in chains:
                on_spine[self.path_nodes(path)] = True

        named = np.zeros(size, dtype=bool)
        named[list(names)] = True
        split = hang[5] > 0
        digests: dict[int, str] = {}
        cuts = np.flatnonzero(np.concatenate([[True], ends_at[1:] != ends_at[:-1]])) if len(ends_at) else []
        ends = [*cuts, len(ends_at)]
        for a, b in zip(ends, ends[1:], strict=False):
            node = int(ends_at[a])
            if on_spine[node] or split[node]:
                for c in range(a, b, CHUNK_IDS):
                    ids = self.convs[c : min(c + CHUNK_IDS, b)].tolist()
                    text = ",".join(map(str, ids)).encode()
                    rows.add(kind=CHUNK, key=names[node], seq=ids[0], path=text)
                hang[5, node] = 1
            else:
                digests[node] = hashlib.sha256(",".join(map(str, self.convs[a:b].tolist())).encode()).hexdigest()
        split = hang[5] > 0

        for node in np.flatnonzero(~on_spine).tolist():
            parent = int(self.parent[node])
            open_parent = parent >= 0 and on_spine[parent]
            rows.add(
                kind=NODE,
                key=names[node] if named[node] else None,
                parent_key=names[parent] if open_parent else None,
                conv_id=int(least[node]),
                depth=int(self.depth[node]),
                parent_conv_id=None if open_parent or parent < 0 else int(least[parent]),
                n_convs=int(n_convs[node]),
                n_children=int(n_children[node]),
                n_leaves=int(n_leaves[node]),
                saved_tokens=int(saved[node]),
                ends_sha256=None if split[node] else digests.get(node, NO_ENDS),
                seq=int(split[node]),
            )
        if whole:
            return []
        # Finished subtrees hang on their parents, which are on a spine.
        top = np.flatnonzero(~on_spine & on_spine[self.parent])
        over = self.parent[top]
        for i, values in ((0, n_convs), (2, n_leaves), (3, saved)):
            np.add.at(hang[i], over, values[top])
        np.add.at(hang[4], over, 1)
        np.minimum.at(hang[1], over, least[top])
        spines, taken = [], np.zeros(size, dtype=bool)
        for path in chains[:1] if chains[0] == chains[1] else chains:
            nodes = self.path_nodes(path)
            if path and taken[nodes].all():  # nothing of its own
                continue
            own = hang[:, nodes].copy()
            # The part that both paths share is the first one's.
            own[:, taken[nodes]] = 0
            own[1, taken[nodes]] = NO_CONV
            taken[nodes] = True
            part = slice(self.begin[path], self.begin[path] + self.sizes[path])
            spines.append(Spine(self.keys[part].copy(), self.lens[part].copy(), own))
        return spines


NO_ENDS = hashlib.sha256(b"").hexdigest()


def _keys(buffer: bytes) -> np.ndarray:
    return np.frombuffer(buffer, dtype="<u8").reshape(-1, KEY_BYTES // 8)


def _emit(spines: list[Spine], sequence: int, rows: Rows) -> None:
    for i, spine in enumerate(spines):
        rows.add(
            kind=SPINE,
            seq=sequence * 2 + i,
            path=spine.keys.tobytes(),
            lens=spine.lens.tobytes(),
            hang=spine.hang.tobytes(),
        )


def _encode(block_turns: int):
    """Tries of the conversations of a task: sorted rows (path, conv_id, lens)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, spines, rows = TaskContext.get().partitionId(), [], Rows()
        waiting: list[tuple[np.ndarray, ...]] = []

        def solve() -> list[Spine]:
            columns = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            waiting.clear()
            return Block(spines, *columns).solve(sequence, False, rows)

        turns = items = 0
        for batch in batches:
            sizes = np.array(batch.column("n").to_pylist(), dtype=np.int64)
            keys = _keys(b"".join(x.as_py() for x in batch.column("path")))
            lens = batch.column("lens").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            convs = batch.column("conv_id").to_numpy()
            ends, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
            while begin < len(sizes):
                # Up to the conversation that fills the block.
                full = int(np.searchsorted(ends, ends[begin] + block_turns - turns, side="left"))
                end = min(len(sizes), max(full, begin + LEAST_ITEMS - items, begin + 1))
                part = slice(ends[begin], ends[end])
                waiting.append((keys[part], lens[part], sizes[begin:end], convs[begin:end]))
                turns, items = turns + int(ends[end] - ends[begin]) + end - begin, items + end - begin
                begin = end
                if turns >= block_turns and items >= LEAST_ITEMS:
                    spines = solve()
                    turns = items = 0
                    yield from rows.batches(20_000)
        if waiting:
            spines = solve()
        _emit(spines, sequence, rows)
        yield from rows.batches()

    return read


def _merge(whole: bool):
    """Spines of a group of tasks, sorted by group and sequence, made one trie; ``whole``: of all tasks."""
    nothing = np.empty((0, KEY_BYTES // 8), dtype="<u8"), *(np.empty(0, dtype=np.int64) for _ in range(3))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, spines, group, fresh, turns = Rows(), [], None, 0, 0

        def solve(close: bool) -> list[Spine]:
            return Block(spines, *nothing).solve(group, close, rows)

        for batch in batches:
            for row in batch.to_pylist():
                if row["g"] != group:
                    if spines:
                        _emit(solve(whole), group, rows)
                    spines, group, fresh, turns = [], row["g"], 0, 0
                lens = np.frombuffer(row["lens"], dtype=np.int64)
                hang = np.frombuffer(row["hang"], dtype=np.int64).reshape(len(HANGING), -1)
                spines.append(Spine(_keys(row["path"]), lens, hang))
                fresh, turns = fresh + 1, turns + len(lens) + 1
                if turns >= BLOCK_TURNS and fresh >= LEAST_ITEMS:
                    spines, fresh, turns = solve(False), 0, 0
                    yield from rows.batches(20_000)
        if spines:
            _emit(solve(whole), group, rows)
        yield from rows.batches()

    return read


def _hashed_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per key of its chunks in order, joined by commas; the rows are sorted by key and place."""
    key, digest = None, None

    def row() -> pa.RecordBatch:
        columns = [pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["of", "joined_sha256"])

    for batch in batches:
        for own, chunk in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), strict=True):
            if own != key:
                if digest is not None:
                    yield row()
                key, digest = own, hashlib.sha256(chunk)
            else:
                digest.update(b",")
                digest.update(chunk)
    if digest is not None:
        yield row()


def turn_paths(conversations: DataFrame) -> DataFrame:
    """A row per conversation: its turns in order, each with a hash of role and text (32 hex digits) and a length."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn"),
        role.alias("role"),
        F.substring(F.sha2(told, 256), 1, 2 * KEY_BYTES).alias("key"),
        F.char_length(text).alias("len"),
    )
    rows = conversations.filter("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    # A list per conversation, of hashes and lengths; sort_array puts nulls first.
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return ordered.select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["len"].alias("len"))).alias("turns")
    )


def with_shared_heads(paths: DataFrame, heads: Column, base: Column, shared: Column, most: int) -> DataFrame:
    """Each conversation with its first ``heads`` turns replaced by those of the conversation ``base``.

    ``shared`` tells which conversations are a base of others; ``heads`` is at most ``most``.
    """
    sources = paths.filter(shared).select(F.col("conv_id").alias("of"), F.slice("turns", 1, most).alias("head"))
    rows = paths.select("conv_id", "turns", heads.alias("h"), base.alias("base"))
    joined = rows.join(sources, F.col("base") == F.col("of"), "left")
    none = F.array().cast("array<struct<key:string,len:int>>")
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def build(paths: DataFrame, block_turns: int = BLOCK_TURNS, fan_in: int = FAN_IN) -> DataFrame:
    """All nodes of the trie of ``paths`` (conv_id, turns: key and len), a row each."""
    binary = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    lens = F.transform("turns", lambda t: t["len"])
    items = paths.select("conv_id", F.size("turns").alias("n"), binary.alias("path"), lens.alias("lens"))
    items = items.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    levels = [staged(items.mapInArrow(_encode(block_turns), ROWS), "trie-blocks")]
    while True:
        spines = levels[-1].filter(F.col("kind") == SPINE)
        tasks = spines.agg(F.max("seq")).first()[0]  # two numbers per task of the level before
        if tasks is None:
            break
        whole = tasks // 2 < fan_in
        group = F.lit(0).cast("long") if whole else F.floor(F.col("seq") / (2 * fan_in))
        sorted_spines = spines.select(group.alias("g"), "seq", "path", "lens", "hang").repartition("g")
        merged = sorted_spines.sortWithinPartitions("g", "seq").mapInArrow(_merge(whole), ROWS)
        levels.append(staged(merged, "trie-spines"))
        if whole:
            break

    def of_kind(kind: int, *columns: str) -> DataFrame:
        parts = [level.filter(F.col("kind") == kind).select(*columns) for level in levels]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionAll(part)
        return whole

    chunks = of_kind(CHUNK, "key", "seq", "path").repartition("key").sortWithinPartitions("key", "seq")
    hashed = chunks.mapInArrow(_hashed_chunks, "of binary, joined_sha256 string")
    nodes = of_kind(NODE, "key", "parent_key", "seq", *RESULT)
    once = (F.col("seq") == 0) & F.col("parent_key").isNull()
    finished = nodes.filter(once).select(*RESULT)
    rest = nodes.filter(~once)
    # Nodes that ever were on a spine: two paths per block.
    parents = nodes.filter("key is not null").select(F.col("key").alias("over"), F.col("conv_id").alias("over_conv"))
    parents, hashed = staged(parents, "trie-spine-nodes"), staged(hashed, "trie-ends")
    split = F.when(F.col("seq") == 1, F.col("key"))
    joined = rest.join(parents, F.col("parent_key") == F.col("over"), "left")
    joined = joined.join(hashed, split == F.col("of"), "left")
    joined = joined.withColumns(
        {
            "parent_conv_id": F.coalesce("parent_conv_id", "over_conv"),
            "ends_sha256": F.coalesce("ends_sha256", "joined_sha256"),
        }
    )
    return finished.unionAll(joined.select(*RESULT))
