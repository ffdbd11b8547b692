"""N-gram Jaccard self-join by prefix trees.

1. Every text becomes its set of word n-grams (64-bit hashes). Equal sets form a class, for which one row stands.
2. N-grams have one global order: rare before frequent, then by hash. Two sets that reach the similarity share a few
   n-grams in their prefixes (``least_shared``), so documents that share so many, and whose sizes allow it, are brought
   into one block. One n-gram that documents share by chance joins no blocks.
3. The sets of a block, in the global order of hashes, are put into a prefix tree one after the other. Each set first
   walks the tree: it adds up the overlap of shared paths once, and leaves a subtree when the lengths that remain cannot reach the similarity, or when
   all of it is already linked to the set.
4. Links and classes give components.

A block of many n-grams is cut into chunks. Chunks are joined alone, then one set of each of their components together;
in blocks that still have several components, the sets that share an n-gram of their prefixes are joined, for every such
n-gram, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import materialize
from .common import maybe_in, mix64, random_words, slices, utf8
from .graph import connected_components

#: N-grams that are counted together in a task, the count from which one is reported as frequent, and the length of the
#: list of frequent ones that is broadcast. These only shape the order: any order gives the same links.
COUNTED = 2_000_000
FREQUENT = 4
FREQUENT_LIST = 200_000
#: Documents of an n-gram up to which pairs of them are counted; n-grams of more are linked through one document.
PAIRED = 8
#: Size that adds one to the n-grams that prefixes must share.
SHARED = 25
#: N-grams of a chunk of a block.
CHUNK = 1_500_000
#: Tasks over which the rows of one class, or of one frequent n-gram, are dealt.
SALTS = 16

_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_STEP = random_words(64, 3)
_KEY = random_words(1, 1)[0]
#: Masks of the first bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, ASCII letters in lower case, and the offsets of rows among them.

    A word's bytes are taken by eights; each is mixed with its place, and their sum with the word's length.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    gap = _GAP[data]
    rows = np.diff(at) > 0
    firsts, lasts = at[:-1][rows], at[1:][rows] - 1
    start, stop = ~gap, ~gap
    start[1:] &= gap[:-1]
    start[firsts] = ~gap[firsts]
    stop[:-1] &= gap[1:]
    stop[lasts] = ~gap[lasts]
    w = np.flatnonzero(start)
    size = np.flatnonzero(stop) + 1 - w
    eights = np.ndarray((n,), "<u8", np.concatenate([_LOWER[data], np.zeros(8, np.uint8)]), strides=(1,))
    parts = (size + 7) >> 3
    head = np.cumsum(parts) - parts
    if len(w) and int(parts.max()) > 1:
        k = np.arange(int(parts.sum())) - np.repeat(head, parts)
        left = np.repeat(size, parts) - 8 * k
        x = eights[np.repeat(w, parts) + 8 * k] & _FIRST[np.minimum(left, 8)]
        h = np.add.reduceat(mix64(x + _KEY * (k + 1).astype(np.uint64)), head)
    else:
        h = mix64((eights[w] & _FIRST[size]) + _KEY)
    return mix64(h + size.astype(np.uint64)), np.searchsorted(w, at).astype(np.int64)


def shingle_table(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of all rows, and the offsets of rows; fewer words make one n-gram, no words none."""
    h, cut = word_hashes(data, at)
    count = np.diff(cut)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(size)])
    flat = np.zeros(int(to[-1]), np.uint64)
    full = count >= n
    if full.any():
        grams = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            grams += h[k : len(h) - n + 1 + k] * _STEP[k]
        inside = np.zeros(len(h) + 1, np.int64)
        inside[cut[:-1][full]] += 1
        np.add.at(inside, cut[1:][full] - n + 1, -1)
        flat[np.repeat(full, size)] = mix64(grams[np.cumsum(inside[: len(grams)]) > 0])
    for i in np.flatnonzero((count > 0) & ~full).tolist():
        a, b = cut[i], cut[i + 1]
        flat[to[i]] = mix64(np.array([(h[a:b] * _STEP[n : n + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))[0]
    for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True):
        if b - a > 1:
            flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[to[:-1][to[:-1] < len(flat)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return flat[new], kept[to]


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    values, cut = shingle_table(data, at, n)
    return [values[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def signatures(values: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two arrays of signed longs."""
    out = []
    for x in (mix64(values), mix64(values * _STEP[40] + _STEP[41])):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        out.append((sums[cut[1:]] - sums[cut[:-1]]).view(np.int64))
    return out[0], out[1]


def needed(x: int, y: int, percent: int) -> int:
    """The least overlap of sets of these sizes that reaches the similarity."""
    return -(-percent * (x + y) // (100 + percent))


def least_shared(size):
    """N-grams that the prefixes of two sets have in common at least; of two sets, the smaller one's. A number or a column."""
    return size // SHARED + 1 if isinstance(size, int) else F.floor(size / SHARED) + 1


class _Node:
    __slots__ = ("children", "end", "largest", "least", "mixed", "owner", "ranks", "sets")

    def __init__(self, ranks: np.ndarray, end: int, size: int, owner: int):
        self.ranks, self.end, self.children, self.sets = ranks, end, {}, []
        self.least = self.largest = size
        self.owner, self.mixed = owner, False


class PrefixTree:
    """A compressed prefix tree of sets given as ascending ranks, with a union-find of the sets that are linked."""

    def __init__(self, universe: int, percent: int):
        self.root = _Node(np.zeros(0, np.int64), 0, 0, 0)
        self.root.mixed = True
        self.marks = np.zeros(universe, bool)
        self.percent = percent
        self.parent: list[int] = []
        self.size: list[int] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def link(self, x: np.ndarray, i: int) -> None:
        """Link set ``i`` with every component of the tree that has a set similar to it."""
        n, p, marks = len(x), self.percent, self.marks
        marks[x] = True
        todo = [(c, 0) for c in self.root.children.values()]
        while todo:
            node, overlap = todo.pop()
            if node.largest * 100 < p * n or node.least * p > 100 * n or (not node.mixed and self.find(node.owner) == self.find(i)):
                continue
            overlap += int(np.count_nonzero(marks[node.ranks]))
            rest = n - int(np.searchsorted(x, node.ranks[-1], side="right"))
            if overlap + min(node.largest - node.end, rest) < needed(n, node.least, p):
                continue
            for j in node.sets:
                if (100 + p) * overlap >= p * (n + self.size[j]):
                    self.union(i, j)
            todo += [(c, overlap) for c in node.children.values()]
        marks[x] = False

    def insert(self, x: np.ndarray, i: int) -> None:
        n, node, at = len(x), self.root, 0
        while True:
            child = node.children.get(int(x[at])) if at < n else None
            if child is None:
                break
            k = min(len(child.ranks), n - at)
            differ = np.flatnonzero(child.ranks[:k] != x[at : at + k])
            k = int(differ[0]) if len(differ) else k
            if k < len(child.ranks):
                upper = _Node(child.ranks[:k], child.end - len(child.ranks) + k, child.least, child.owner)
                upper.largest, upper.mixed = child.largest, child.mixed
                child.ranks = child.ranks[k:]
                upper.children[int(child.ranks[0])] = child
                node.children[int(x[at])] = upper
                child = upper
            child.least, child.largest = min(child.least, n), max(child.largest, n)
            child.mixed = child.mixed or self.find(child.owner) != self.find(i)
            node, at = child, at + k
        if at < n:
            leaf = _Node(x[at:], n, n, i)
            node.children[int(x[at])] = leaf
            node = leaf
        node.sets.append(i)

    def add(self, x: np.ndarray, label: int | None = None) -> int:
        i = len(self.parent)
        self.parent.append(i)
        self.size.append(len(x))
        if label is not None:
            self.parent[i] = label
        self.link(x, i)
        self.insert(x, i)
        return i


def join_sets(sets: list[np.ndarray], percent: int, labels: list[int] | None = None) -> list[int]:
    """The component (number of its first set, in order of size) of each sorted set; ``labels``: sets that are linked already."""
    # Ranks keep the order of the hashes, which is the same in all blocks.
    known, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    ranks = np.split(inverse, np.cumsum([len(s) for s in sets])[:-1])
    tree = PrefixTree(len(known), percent)
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    seen: dict[int, int] = {}
    number = {}
    for i in order:
        label = None if labels is None else seen.get(labels[i])
        number[i] = tree.add(ranks[i], None if label is None else tree.find(label))
        if labels is not None:
            seen.setdefault(labels[i], number[i])
    return [order[tree.find(number[i])] for i in range(len(sets))]


def text_sets(docs: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds: each row's (row, doc_id, n_shingles, s1, s2), and (token, times) of n-grams frequent in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "n_shingles", "s1", "s2", "token", "times"]
        held, count, known = [], 0, set()

        def frequent() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times >= FREQUENT
            k = int(keep.sum())
            return pa.RecordBatch.from_arrays([*(pa.nulls(k, pa.int64()) for _ in range(5)), pa.array(token[keep].astype(np.int64)), pa.array(times[keep].astype(np.int64))], names)

        for batch in slices(batches, "text"):
            values, cut = shingle_table(*utf8(batch.column("text")), n)
            s1, s2 = signatures(values, cut)
            fresh = np.zeros(len(s1), bool)
            for i, m in enumerate(s1.tolist()):
                if m not in known:
                    known.add(m)
                    fresh[i] = True
            size = np.diff(cut)
            held.append(values[np.repeat(fresh, size)])
            count += len(held[-1])
            none = pa.nulls(len(size), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(size), pa.array(s1), pa.array(s2), none, none], names)
            if count >= COUNTED:
                yield frequent()
                held, count = [], 0
        if held:
            yield frequent()

    return docs.mapInArrow(run, "row long, doc_id long, n_shingles long, s1 long, s2 long, token long, times long")


def prefix_tokens(docs: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(token, row, size, frequent) of the n-grams in each set's prefix; of equal sets in a task, the first row stands for all."""
    held = docs.sparkSession.sparkContext.broadcast(np.sort(frequent.astype(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, known = held.value, set()
        for batch in slices(batches, "text"):
            values, cut = shingle_table(*utf8(batch.column("text")), n)
            marks = list(zip(*(x.tolist() for x in signatures(values, cut)), strict=True))
            slow = late[np.minimum(np.searchsorted(late, values), len(late) - 1)] == values if len(late) else np.zeros(len(values), bool)
            tokens, owners, late_ones = [], [], []
            for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                if a == b or marks[i] in known:
                    continue
                known.add(marks[i])
                s, last = values[a:b], slow[a:b]
                length = min(b - a, b - a - -(-percent * (b - a) // 100) + least_shared(b - a))
                prefix = s[~last][:length]
                rest = length - len(prefix)
                late_ones.append(np.arange(length) >= len(prefix))
                if rest:
                    prefix = np.concatenate([prefix, s[last][:rest]])
                tokens.append(prefix)
                owners.append(i)
            if tokens:
                of = np.repeat(owners, [len(t) for t in tokens])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), batch.column("row").take(pa.array(of)), pa.array(np.diff(cut)[of].astype(np.int32)), pa.array(np.concatenate(late_ones))], ["token", "row", "size", "frequent"])

    return docs.mapInArrow(run, "token long, row long, size int, frequent boolean")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """(token, row, size, many, near): the tokens that several rows have, with the rows before each one by size where they are few.

    ``many`` marks the tokens that are not counted pair by pair: those of more than ``PAIRED`` rows, and the frequent ones.
    The latter skip the window, since one of them may be in a third of all rows.
    """
    by_size = Window.partitionBy("token").orderBy("size", "row")
    counted = tokens.where("not frequent").withColumn("c", F.count("*").over(Window.partitionBy("token")))
    earlier = F.array(*[F.struct(F.lag("row", k).over(by_size).alias("row"), F.lag("size", k).over(by_size).alias("size")) for k in range(1, PAIRED)])
    few = counted.withColumn("near", F.when(F.col("c") <= PAIRED, earlier)).where("c > 1").select("token", "row", "size", (F.col("c") > PAIRED).alias("many"), "near")
    often = tokens.where("frequent").select("token", "row", "size", F.lit(True).alias("many"), F.lit(None).cast(few.schema["near"].dataType).alias("near"))
    return few.union(often)


def candidate_edges(shared: DataFrame, percent: int) -> DataFrame:
    """Edges (x, y) that connect all rows whose prefixes share enough n-grams and whose sizes allow the similarity.

    Pairs are counted over n-grams of few rows. Of the n-grams that a pair shares, the others (``many``) are at most as
    many as either row has of those, h. So a pair that shares enough either has enough counted ones less h, or both rows
    have enough of the others; for those, along an n-gram's rows by size, every row is linked to the first of its run,
    and a run ends where the next size is too large for the last. Rows of one n-gram and size are linked within salts,
    then the salts' first rows, then the sizes': each step has one row for all of the last one's. Edges grow with the
    tokens, not with their squares.
    """
    many = shared.where("many").select("token", "row", "size")
    held = many.groupBy("row").agg(F.count("*").alias("h"))
    near = F.filter("near", lambda e: e["row"].isNotNull() & (e["size"] * 100 >= F.col("size") * percent))
    pairs = shared.where("not many").select("row", "size", F.explode(near).alias("e")).where("row != e.row")
    pairs = pairs.select(F.col("row").alias("x"), F.col("e.row").alias("y"), F.col("e.size").alias("size")).groupBy("x", "y", "size").agg(F.count("*").alias("s"))
    of = [held.select(F.col("row").alias(k), F.col("h").alias(f"h_{k}")) for k in ("x", "y")]
    counts = pairs.join(of[0], "x", "left").join(of[1], "y", "left")
    rest = F.least(*(F.coalesce(f"h_{k}", F.lit(0)) for k in ("x", "y")))
    linked = counts.where(F.col("s") >= least_shared(F.col("size")) - rest).select("x", "y")

    smallest = F.floor(F.col("size") * percent / 100)
    crowded = many.join(held, "row").where(F.col("h") >= least_shared(smallest)).select("token", "row", "size", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    in_salt = Window.partitionBy("token", "size", "salt")
    salted = materialize(crowded.select("token", "size", "salt", "row", F.min("row").over(in_salt).alias("first")), "ngram-crowded")
    heads = salted.where("row = first").select("token", "size", "row", F.min("row").over(Window.partitionBy("token", "size")).alias("first"))
    sizes = heads.where("row = first").select("token", "size", "row")
    by_size = Window.partitionBy("token").orderBy("size")
    last = F.lag("size").over(by_size)
    opened = sizes.withColumn("opens", last.isNull() | (last * 100 < F.col("size") * percent))
    first = F.last(F.when(F.col("opens"), F.col("row")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    runs = opened.withColumn("first", first)
    chains = [x.where("row != first").select(F.col("row").alias("x"), F.col("first").alias("y")) for x in (salted, heads, runs)]
    return linked.union(chains[0]).union(chains[1]).union(chains[2]).distinct()


def join_groups(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Prefix-tree joins of the groups of ``rows`` (task_key, row, label, text): edges (a, b) to the first document of a component.

    Rows come dealt by task_key and sorted by it; a task holds the sets of one group at a time.
    """
    spread = rows.repartition("task_key").sortWithinPartitions("task_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, labels, sets = None, [], [], []

        def solve() -> pa.RecordBatch:
            got = join_sets(sets, percent, None if labels[0] is None else labels)
            edges = [(ids[i], ids[j]) for i, j in enumerate(got) if ids[i] != ids[j]]
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in slices(batches, "text"):
            found = shingle_sets(*utf8(batch.column("text")), n)
            for k, row, label, s in zip(batch.column("task_key").to_pylist(), batch.column("row").to_pylist(), batch.column("label").to_pylist(), found, strict=True):
                if k != key:
                    if len(sets) > 1:
                        yield solve()
                    key, ids, labels, sets = k, [], [], []
                ids.append(row)
                labels.append(label)
                sets.append(s)
        if len(sets) > 1:
            yield solve()

    return spread.select("task_key", "row", "label", "text").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row.

    Documents are linked when 100 * overlap >= percent * union of their sets of distinct word n-grams. class_id is the
    smallest id with an equal set, component_id the smallest id that links reach. Words are runs of anything but ASCII
    white space, ASCII letters in lower case. Texts of fewer than n words have one n-gram; null, empty and blank texts
    have none and are linked with nothing. Every row is a document of its own, whether or not its id repeats; rows with
    a null id take part, and the smallest id is null only where no row has one. Other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return components_of(materialize(rows, "ngram-rows"), n, percent).select("doc_id", "n_shingles", "class_id", "component_id")


def salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))


def for_salts(rows: DataFrame) -> DataFrame:
    """Each row once for every salt, for a join with rows of which one key may have very many."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def components_of(source: DataFrame, n: int, percent: int) -> DataFrame:
    """(row, doc_id, n_shingles, class_id, component_row, component_id) for ``source`` (row, doc_id, text): a table, with unique rows.

    component_row is the smallest row that links reach.
    """
    found = materialize(text_sets(source, n), "ngram-sets")
    counts = found.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(FREQUENT_LIST)
    frequent = np.array([r.token for r in counts.select("token").collect()], np.int64).view(np.uint64)
    mark = ["n_shingles", "s1", "s2"]
    sets = found.where("token is null").select("row", "doc_id", *mark)
    classes = sets.where("n_shingles > 0").groupBy(*mark).agg(F.min("row").alias("class_row"), F.min("doc_id").alias("class_id"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    members = salted(sets).join(for_salts(classes).hint("merge"), [*mark, "salt"], "left")
    alone = F.col("class_row").isNull()
    members = members.select("row", "doc_id", "n_shingles", F.coalesce("class_row", "row").alias("class_row"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
    members = materialize(members, "ngram-classes")

    # From here on a class's first row stands for all its rows.
    class_of = members.select("row", "class_row")
    shared = materialize(shared_tokens(prefix_tokens(source, n, percent, frequent)), "ngram-tokens")
    edges = candidate_edges(shared, percent)
    edges = edges.join(class_of, edges.x == class_of.row).select(F.col("class_row").alias("a"), "y")
    edges = edges.join(class_of, edges.y == class_of.row).select("a", F.col("class_row").alias("b"))
    blocks = connected_components(edges)
    sized = blocks.join(members, blocks.node == members.row).select("row", F.col("root").alias("block"), "n_shingles")
    totals = sized.groupBy("block").agg(F.sum("n_shingles").alias("total")).select("block", F.ceil(F.col("total") / CHUNK).cast("int").alias("chunks"))
    placed = sized.join(totals, "block").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
    rows = materialize(placed.select("row", "block", "chunks", "chunk", "n_shingles"), "ngram-blocks")
    texts = maybe_in(source.select("row", "text"), "row", rows.select("row")).join(rows, "row").withColumn("label", F.lit(None).cast("long"))
    keyed = F.struct("block", "chunk")
    links = materialize(join_groups(texts.select(F.xxhash64(keyed).alias("task_key"), "row", "label", "text"), n, percent), "ngram-links")
    large = rows.where("chunks > 1")
    if not large.isEmpty():
        links = _join_chunks(source, large, links, shared.select("token", "row").join(class_of, "row").select("token", F.col("class_row").alias("row")).distinct(), n, percent)
    roots = materialize(connected_components(links), "ngram-roots")
    # Components of several classes, with the smallest id of theirs; all else is a component of its class.
    ids = roots.join(members.select("row", "class_id"), roots.node == members.row).groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = for_salts(roots.join(ids, "root").select(F.col("node").alias("class_row"), F.col("root").alias("component_row"), "component_id"))
    out = salted(members).join(named.hint("merge"), ["class_row", "salt"], "left")
    return out.select(
        "row", "doc_id", "n_shingles", "class_id", F.coalesce("component_row", "class_row").alias("component_row"),
        F.when(F.col("component_row").isNull(), F.col("class_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _join_chunks(source: DataFrame, large: DataFrame, links: DataFrame, tokens: DataFrame, n: int, percent: int) -> DataFrame:
    """Links across the chunks of blocks that have several. ``tokens``: (token, row) of the n-grams that several rows' prefixes share."""
    texts = materialize(maybe_in(source.select("row", "text"), "row", large.select("row")).join(large, "row"), "ngram-chunks")

    def labelled(links: DataFrame) -> DataFrame:
        roots = connected_components(links)
        return texts.join(roots, texts.row == roots.node, "left").select("row", "block", "n_shingles", "text", F.coalesce("root", "row").alias("label"))

    # One set of each component of a chunk, dealt anew into as many chunks as these need.
    heads = labelled(links).where("row = label")
    counts = heads.groupBy("block").agg(F.count("*").alias("heads"))
    least = heads.join(counts, "block").withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.ceil(F.col("heads") / 1000)))
    more = join_groups(least.select(F.xxhash64(F.struct("block", "part")).alias("task_key"), "row", F.lit(None).cast("long").alias("label"), "text"), n, percent)
    links = materialize(links.union(more), "ngram-links")

    # Whatever is still apart: similar sets share an n-gram of their prefixes, so the sets of each such n-gram are joined.
    # Those of an n-gram that many large sets have are cut into parts, of which every two meet.
    now = labelled(links)
    apart = now.groupBy("block").agg(F.countDistinct("label").alias("labels")).where("labels > 1").select("block")
    rest = materialize(now.join(apart, "block", "left_semi"), "ngram-apart")
    on = tokens.join(rest.select("row", "label", "n_shingles"), "row")
    groups = on.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum("n_shingles").alias("total")).where("low < high")
    dealt = on.join(groups.select("token", F.ceil(F.col("total") / CHUNK).alias("parts")), "token").withColumn("part", F.pmod(F.xxhash64("row", F.lit(2)), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("parts = 1 or other != part")
    dealt = dealt.select("row", F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other")).alias("task_key"))
    last = join_groups(dealt.join(rest.select("row", "label", "text"), "row"), n, percent)
    return materialize(links.union(last), "ngram-links")
