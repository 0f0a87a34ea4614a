"""N-gram Jaccard join by signature trees.

Documents become sets of word shingles; equal sets are one class. Two classes that reach the
threshold share one of the first tokens of both under any fixed order of all tokens (a set of
n tokens needs its first n - ceil(t n) + 1, and the smaller of the two even fewer). Classes are
brought together by those tokens, a block for each token that several classes have, cut where
sizes next to each other are too far apart; blocks with the same classes count once. The order puts frequent tokens last, by counts over the whole corpus, so that passages which many
texts share rarely make blocks.

Signature trees do the join: of some LEAVES classes of many blocks at once, or of a large block's part. Leaves are
classes in blocks, each with a bitmap of its tokens (two bits a token or more) and its size; inner nodes hold the OR of
their children's bitmaps and the ranges of their sizes and blocks. Two nodes are compared from the roots down (dual
traversal) and a pair is left as soon as no pair below can reach the threshold: by their blocks or
sizes, or since no more tokens can be common than the bits both nodes have and the tokens
beyond one a bit. Pairs that links already connect aren't looked at. Of the leaf pairs that the
bound can't exclude, as few as connect all of them are decided by the exact intersection of
their texts' sets. Where one of them fails, its block is traversed once more, now with eight bits
a token and with the tokens' upper 32 bits, which decide a leaf pair but for a chance collision
(it could only add a link, and each link is decided from the texts; if one fails, whole
tokens are used). Only bitmaps, and tokens to the blocks traversed again, travel to the
blocks; texts travel once for a link to be decided. No list of all pairs is ever made.

Tokens are counted before anything is gathered by them. Blocks of frequent tokens, or of over CELL classes, have no
bound. There each class is first held against a pivot, the least class of the block, which connects large groups of near
copies in one step; then only pairs of classes that aren't connected are left, and they are
dealt to cells of about CELL classes at most, each a join of two trees in a task of its own. A block of N classes that
nothing connects goes to some N / CELL cells a class: this work, not its memory, grows with the square of such a block.

The result is links that connect what the threshold connects: components are exact, for any
group size, and no group is expanded into all its pairs. Tokens and sets are told apart by
64-bit hashes.

Defined results: null texts and texts without words have an empty set, linked with nothing;
percent is from 1 to 99, anything else is an error; repeated rows are one class; null ids never become a component's id while another id is there.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import annotate, free, lists, ready
from .components import components
from .store import discard, materialize
from .words import NOT_SPACE, WordHasher, mix, shingles

LEAST_BITS, FANOUT, CELL, PIVOTS = 128, 16, 512, 2
NARROW, WIDE, LEAVES, LEAD = 2, 8, 1024, 256
HOT, MOST_HOT, KEPT = 32, 1 << 16, 1 << 17
MOST_SENT = 8 << 20
MOST_SEEN = 1 << 20


# --- token order ---------------------------------------------------------------------------


class HeavyHitters:
    """Tokens of many sets in bounded memory (Misra-Gries, fed with batches): counts are low by at most what was subtracted."""

    def __init__(self, most: int = KEPT, batch: int = 1 << 20):
        self._most, self._batch = most, batch
        self.tokens, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._waiting: list[np.ndarray] = []
        self._held = 0

    def add(self, tokens: np.ndarray) -> None:
        self._waiting.append(tokens)
        self._held += len(tokens)
        if self._held >= self._batch:
            self.flush()

    def flush(self) -> None:
        if self._held:
            found, times = np.unique(np.concatenate(self._waiting), return_counts=True)
            self._waiting, self._held = [], 0
            both = np.concatenate([self.tokens, found])
            order = np.argsort(both, kind="stable")
            both, counts = both[order], np.concatenate([self.counts, times])[order]
            first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
            self.tokens, self.counts = both[first], np.add.reduceat(counts, first)
            if len(self.counts) > self._most:
                cut = np.partition(self.counts, -self._most - 1)[-self._most - 1]
                keep = self.counts > cut
                self.tokens, self.counts = self.tokens[keep], self.counts[keep] - cut


def frequent_tokens(docs: DataFrame, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, their counts) of at most MOST_HOT tokens of HOT or more documents; it only sets the order, never the result."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, found = WordHasher(NOT_SPACE), HeavyHitters()
        for batch in batches:
            for _, part in hasher.texts(batch.column(0)):
                for words in part:
                    found.add(shingles(words, k))
        found.flush()
        often = found.counts > 1
        if often.any():
            yield pa.RecordBatch.from_arrays([pa.array(found.tokens[often].view(np.int64)), pa.array(found.counts[often])], names=["token", "n"])

    seen = materialize(docs.select(docs[f"`{text}`"]).mapInArrow(run, "token long, n long"), "token-counts")
    top = seen.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "token").limit(MOST_HOT).toArrow()
    tokens, counts = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def prefix_length(n: int, percent: int) -> int:
    """Of a set of n tokens: any set that reaches percent shares one of so many first tokens."""
    return n - -(-percent * n // 100) + 1 if n else 0


# --- signature trees -----------------------------------------------------------------------


def bitmap(tokens: np.ndarray, per_token: int) -> bytes:
    """A power of two of bits, per_token bits a token at least."""
    bits = max(LEAST_BITS, 1 << max(0, per_token * len(tokens) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(tokens & (bits - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def folded(bits: np.ndarray, times: int = 1) -> np.ndarray:
    """Bitmaps (a row each) of half the width `times` over, as if made so: a token's bit is its lowest binary digits."""
    for _ in range(times):
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class Tree:
    """levels[0] are the leaves, in order of block and size; a node of a level covers FANOUT nodes of the one below.

    Of each node: OR of the bitmaps, least and greatest size, most tokens beyond the bits, least and greatest block."""

    def __init__(self, names: list, sizes: np.ndarray, bits: np.ndarray, blocks: np.ndarray):
        order = np.lexsort((bits[:, 0], sizes, blocks))
        self.names = [names[i] for i in order.tolist()]
        bits, sizes, blocks = bits[order], sizes[order], blocks[order]
        spare = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)  # tokens that share a bit with another
        self.levels = [(bits, sizes, sizes, spare, blocks, blocks)]
        while len(self.levels[-1][0]) > 1:
            below = self.levels[-1]
            cuts = np.arange(0, len(below[0]), FANOUT)
            self.levels.append(tuple(f.reduceat(x, cuts) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum), below)))


def _possible(a: tuple, i: int, b: tuple, at: np.ndarray, percent: int) -> np.ndarray:
    """Of the nodes `at` of level b, those below which some pair with node i of level a can reach percent.

    A pair of sizes x <= y can have at most as many tokens in common as x, and as the bits
    that both nodes have, and the tokens of one set beyond its bits."""
    low, high = int(a[1][i]), int(a[2][i])
    at = at[(a[4][i] <= b[5][at]) & (a[5][i] >= b[4][at])]  # the same block
    blow, bhigh = b[1][at], b[2][at]
    most = np.bitwise_count(a[0][i] & b[0][at]).sum(axis=1, dtype=np.int64) + np.minimum(int(a[3][i]), b[3][at])
    sizes = (100 * high >= percent * blow) & (100 * bhigh >= percent * low)
    least = np.maximum(low, -(-percent * blow // 100)) + np.maximum(blow, -(-percent * low // 100))  # of both sizes together
    return at[sizes & ((100 + percent) * most >= percent * least)]


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach percent, exactly."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    c = int((y[at] == x).sum())
    return 100 * c >= percent * (len(x) + len(y) - c)


class Groups:
    """Union-find over names; links that joined two groups are kept."""

    def __init__(self):
        self._up: dict = {}
        self.links: list[tuple] = []

    def root(self, x):
        up = self._up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x, y, link: tuple | None = None) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self._up[max(x, y)] = min(x, y)
            if link:
                self.links.append(link)


class Leaves:
    """What is known of the leaves: groups, and where sets are given, which pairs were held against each other. asked, left: of each level, node pairs looked at and gone on with."""

    def __init__(self, percent: int):
        self.groups, self.percent = Groups(), percent
        self.sets: dict = {}
        self.apart: set[tuple] = set()
        self.asked, self.left = Counter(), Counter()

    def meet(self, x, y) -> None:
        if x == y or self.groups.root(x) == self.groups.root(y):
            return
        pair = (min(x, y), max(x, y))
        if self.sets:
            if pair in self.apart:
                return
            if not reaches(self.sets[x], self.sets[y], self.percent):
                if len(self.apart) < MOST_SEEN:
                    self.apart.add(pair)
                return
        self.groups.join(x, y, pair)


def dual_traversal(a: Tree, b: Tree, leaves: Leaves) -> None:
    """Lets each leaf of a meet each leaf of b of its block that the bound can't exclude; a may be b."""
    same, percent = a is b, leaves.percent
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, np.zeros(1, np.int64))]
    while stack:
        la, i, lb, at = stack.pop()
        leaves.asked[la] += len(at)
        at = _possible(a.levels[la], i, b.levels[lb], at, percent)
        leaves.left[la] += len(at)
        if not len(at):
            continue
        if la == 0 and lb == 0:
            for j in at.tolist():
                if not (same and j <= i):
                    leaves.meet(a.names[i], b.names[j])
        elif lb >= la:
            below = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            below = below[below < len(b.levels[lb - 1][0])]
            if len(below):
                stack.append((la, i, lb - 1, below))
        else:
            for k in range(i * FANOUT, min((i + 1) * FANOUT, len(a.levels[la - 1][0]))):
                first = at[at >= k] if same and lb == la - 1 else at  # of two nodes of a level, the first one looks at the other
                if len(first):
                    stack.append((la - 1, k, lb, first))


#: A leaf: block, name, size, bitmap, group or None (leaves of a group are connected already; a group is named as its least leaf).
Leaf = tuple[int, object, int, bytes, object]


def _by_width(side: list[Leaf]) -> dict[int, tuple]:
    """Names, sizes, bitmaps and blocks of each width."""
    out: dict[int, list] = {}
    for leaf in side:
        out.setdefault(len(leaf[3]) * 8, []).append(leaf)
    numbers = {block: i for i, block in enumerate(dict.fromkeys(x[0] for x in side))}
    return {w: ([x[1] for x in rows], np.array([x[2] for x in rows], np.int64), np.frombuffer(b"".join(x[3] for x in rows), np.uint64).reshape(len(rows), -1), np.array([numbers[x[0]] for x in rows], np.int64)) for w, rows in out.items()}


def width_steps(percent: int) -> int:
    """By how many doublings the widths of two sets that reach percent can differ."""
    steps = 1
    while percent << steps < 100:
        steps += 1
    return steps


def tree_pairs(left: list[Leaf], right: list[Leaf] | None, leaves: Leaves) -> None:
    """Lets leaves of one block meet among left, or (of one block alone) between left and right.

    Sets of one width have a tree. Sets that can reach each other differ by one width at most from 50 percent on, and
    by one more each time that this is halved."""
    for side in (left, right or []):
        for _, name, _, _, group in side:
            if group is not None and group != name:
                leaves.groups.join(group, name)
    a = _by_width(left)
    b = a if right is None else _by_width(right)
    trees = {w: Tree(*x) for w, x in a.items()}
    others = trees if right is None else {w: Tree(*x) for w, x in b.items()}
    for w, tree in trees.items():
        if w in others:
            dual_traversal(tree, others[w], leaves)
        for step in range(1, width_steps(leaves.percent) + 1):
            if w << step in b:
                names, sizes, bits, blocks = b[w << step]
                dual_traversal(tree, Tree(names, sizes, folded(bits, step), blocks), leaves)
            if right is not None and w >> step in b:
                names, sizes, bits, blocks = a[w]
                dual_traversal(Tree(names, sizes, folded(bits, step), blocks), others[w >> step], leaves)


# --- the join ------------------------------------------------------------------------------


def _sets(docs: DataFrame, doc_id: str, text: str, k: int, percent: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, h (hash of the text), n, cls (hash of the set; null if empty), bits (its bitmap), first (leading tokens), hot (those of them that are frequent)."""
    sent = docs.sparkSession.sparkContext.broadcast(order)
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("t")).withColumn("h", F.xxhash64("t"))

    def make():
        hasher, (frequent, counts) = WordHasher(NOT_SPACE), sent.value

        def work(column):
            sizes, classes, bits, first, hot = [], [], [], [], []
            nothing = np.empty(0, np.int64)
            for _, part in hasher.texts(column):
                for words in part:
                    tokens = shingles(words, k)
                    n = len(tokens)
                    sizes.append(n)
                    if not n:
                        classes.append(None)
                        bits.append(None)
                        first.append(nothing)
                        hot.append(nothing)
                        continue
                    classes.append(int(mix(mix(tokens).sum(keepdims=True) + np.uint64(n)).view(np.int64)[0]))
                    bits.append(bitmap(tokens, NARROW))
                    p = prefix_length(n, percent)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                        often = frequent[at] == tokens
                    else:
                        often = np.zeros(n, bool)
                    rare = tokens[~often][:p]
                    first.append(rare.view(np.int64))
                    if len(rare) < p:
                        late, times = tokens[often], counts[at[often]]
                        hot.append(late[np.lexsort((late, times))][: p - len(rare)].view(np.int64))
                    else:
                        hot.append(nothing)
            return [pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(bits, pa.binary()), lists(first, pa.int64()), lists(hot, pa.int64())]

        return work

    tokens = T.ArrayType(T.LongType())
    fields = [T.StructField("n", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("first", tokens), T.StructField("hot", tokens)]
    return materialize(annotate(rows, ["t"], make, fields, ["doc_id", "h"]), "sets")


def _same_blocks_once(rows: DataFrame, block: str) -> DataFrame:
    """Of rows (block, cls): one block for each set of classes."""
    each = rows.groupBy(block).agg(F.count("*").alias("n"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("x"), F.bit_xor(F.xxhash64(F.lit("block"), "cls")).alias("y"))
    return each.where("n > 1").groupBy("n", "x", "y").agg(F.min(block).alias(block)).select(block)


def _candidates(cells: DataFrame, classes: DataFrame, percent: int, size: int = 0) -> DataFrame:
    """cells: (cell, side, cls, grp): in each cell side 0 is joined with side 1, or with itself where no side 1 is there. classes: (cls, n, bits); with a size, bits are the tokens, in so many bytes each, and cells have a lead: those of one share a task and what they find. Returns (cell, a, b) to be decided."""
    ready(cells.sparkSession)
    if size:  # tokens travel once to the task where cells of the same lead meet, before the cells
        sent = cells.select("lead", "cls").distinct().join(classes, "cls").withColumns({"cell": F.lit(None).cast("long"), "side": F.lit(0), "grp": F.lit(None).cast("long")})
        rows = cells.withColumns({"n": F.lit(None).cast("long"), "bits": F.lit(None).cast("binary")}).unionByName(sent)
    else:
        rows = cells.withColumn("lead", F.col("cell")).join(classes, "cls")
    rows = rows.select("lead", "cell", "side", "cls", "grp", "n", "bits").repartition("lead").sortWithinPartitions(F.col("lead"), F.col("cell").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks that are joined with themselves wait until a tree of LEAVES of them is worth its while. Without sets, what is found of a block
        # holds for this block alone, so its leaves are named by block and class; with sets, blocks of a lead share it.
        now, sides, waiting, out, leaves, known = (None, None), ([], []), [], [], Leaves(percent), {}

        def found():
            for x, y in leaves.groups.links:
                out.append((x[0], x[1], y[1]) if not size else (now[1], x, y))
            leaves.groups.links.clear()

        def flush():
            nonlocal leaves
            if waiting:
                tree_pairs(waiting, None, leaves)
                waiting.clear()
                found()
            leaves = leaves if size else Leaves(percent)

        def close():
            left, right = sides
            if right:
                flush()
                if left:
                    tree_pairs(left, right, leaves)
                    found()
            elif len(left) > 1:
                waiting.extend(left)
                if size or len(waiting) >= LEAVES:
                    flush()

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["cell", "a", "b"])
            out.clear()
            return batch

        for batch in batches:
            for lead, cell, side, cls, grp, n, bits in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (lead, cell) != now:
                    close()
                    if size and lead != now[0]:
                        leaves = Leaves(percent)
                        known.clear()
                    now, sides = (lead, cell), ([], [])
                if size and cell is None:
                    leaves.sets[cls] = tokens = np.frombuffer(bits, f"<u{size}")
                    known[cls] = (n, bitmap(tokens, WIDE))
                elif size:
                    sides[side].append((cell, cls, *known[cls], grp))
                else:
                    sides[side].append((cell, (cell, cls), n, bits, None if grp is None else (cell, grp)))
            if out:
                yield made()
        close()
        flush()
        if out:
            yield made()

    return rows.mapInArrow(run, "cell long, a long, b long")


def _decided(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs: distinct (a, b). Returns (a, b, ok): whether their sets reach percent, from their texts."""
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("cls"))
    rows = sides.join(texts, "cls").select("a", "b", "cls", "t").repartition("a", "b").sortWithinPartitions("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, now, held = WordHasher(NOT_SPACE), None, {}
        for batch in batches:
            out = []
            tokens = (shingles(words, k) for _, part in hasher.texts(batch.column(3)) for words in part)
            for a, b, cls, s in zip(*(batch.column(i).to_pylist() for i in range(3)), tokens):
                if (a, b) != now:
                    now, held = (a, b), {}
                if cls not in held:
                    held[cls] = s
                    if len(held) == 2:
                        out.append((a, b, reaches(*held.values(), percent)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.bool_())], names=["a", "b", "ok"])

    return rows.mapInArrow(run, "a long, b long, ok boolean")


def _links(cells: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """(a, b): links that connect all pairs of all cells that reach percent. cells is a written table."""

    def decide(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        return materialize(_decided(pairs, _texts(docs, doc_id, text, needed, classes), k, percent), "decided")

    asked = materialize(_candidates(cells, classes.select("cls", "n", "bits"), percent), "asked")
    done = decide(asked.select("a", "b").distinct())
    links = done.where("ok").select("a", "b")
    for size in (4, 8):
        wrong = done.where("not ok")
        if wrong.isEmpty():
            break
        if size == 4:
            again = materialize(asked.join(wrong, ["a", "b"], "left_semi").select("cell").distinct(), "again")
            cells = cells.join(again.hint("shuffle_hash"), "cell", "left_semi")  # dealt by cell, not read by map outputs
        left = cells.join(components(links), F.col("cls") == F.col("node"), "left").select("cell", "side", "cls", F.coalesce("root", "grp").alias("grp"))
        # Blocks with the same least and greatest class share a task and what it finds, in turn some LEAD rows of them.
        family = cells.groupBy("cell").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("low", "high").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        lead = family.select("cell", F.xxhash64("low", "high", F.floor(before / LEAD)).alias("lead"))
        cells = materialize(left.join(lead, "cell"), "left")
        tokens = _tokens(_texts(docs, doc_id, text, cells.select("cls").distinct(), classes), k, size)
        asked = materialize(_candidates(cells, tokens, percent, size), "asked-again")
        done = decide(asked.select("a", "b").distinct())
        links = links.unionByName(done.where("ok").select("a", "b"))
    return links


def _tokens(texts: DataFrame, k: int, size: int) -> DataFrame:
    """(cls, n, bits): the sorted tokens of each class, their upper `size` bytes each."""

    def make():
        hasher = WordHasher(NOT_SPACE)

        def work(column):
            sets = [shingles(words, k) for _, part in hasher.texts(column) for words in part]
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array([(s >> np.uint64(64 - 8 * size)).astype(f"<u{size}").tobytes() for s in sets], pa.binary())]

        return work

    return annotate(texts, ["t"], make, [T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType())], ["cls"])


def _texts(docs: DataFrame, doc_id: str, text: str, needed: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, t) of the needed classes, from the row that stands for each; their ids are sent to the documents while they take MOST_SENT bytes at most."""
    stands = classes.join(needed, "cls", "left_semi").select("cls", "doc_id", "h")
    stands = materialize(stands, "stands")
    few = (stands.agg(F.sum(F.coalesce(F.octet_length(F.col("doc_id").cast("string")), F.lit(0)) + 24)).first()[0] or 0) <= MOST_SENT  # bytes
    rows = docs.select(docs[f"`{doc_id}`"].alias("d"), docs[f"`{text}`"].alias("t"), F.xxhash64(docs[f"`{text}`"]).alias("th"))
    same = rows["d"].eqNullSafe(stands["doc_id"]) & (rows["th"] == stands["h"])
    found = rows.join(F.broadcast(stands) if few else stands, same).select("cls", "t")
    return found


def _cells(rows: DataFrame) -> DataFrame:
    """rows: (token, cls, grp), connected classes with one grp. Pairs of parts of the classes outside a token's largest group, and of those with the largest group."""
    sizes = rows.groupBy("token", "grp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("token").agg(F.max_by("grp", F.struct("n", "grp")).alias("top"), F.sum("n").alias("all"), F.max("n").alias("top_n"), F.count("*").alias("groups"))
    parts = lambda n: F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n / (CELL // 2), F.lit(1.0))))).cast("int")  # noqa: E731  a power of two, so that tokens deal the same classes alike
    open_ = largest.where("groups > 1").select("token", "top", parts(F.col("all") - F.col("top_n")).alias("rest_parts"), parts(F.col("top_n")).alias("top_parts"))
    marked = rows.join(open_, "token").withColumn("hash", F.xxhash64("cls"))
    rest = marked.where("grp <> top").withColumn("part", F.pmod("hash", "rest_parts").cast("int"))
    main = marked.where("grp = top").withColumn("part", F.pmod("hash", "top_parts").cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pair = lambda i, j, kind: F.xxhash64("token", i, j, F.lit(kind))
    inner = rest.withColumn("other", every("rest_parts"))
    inner = inner.select(pair(F.least("part", "other"), F.greatest("part", "other"), "rest").alias("cell"), F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"), "cls", "grp")
    outer = rest.withColumn("other", every("top_parts")).select(pair(F.col("part"), F.col("other"), "top").alias("cell"), F.lit(0).alias("side"), "cls", "grp")
    across = main.withColumn("other", every("rest_parts")).select(pair(F.col("other"), F.col("part"), "top").alias("cell"), F.lit(1).alias("side"), "cls", "grp")
    return inner.unionByName(outer).unionByName(across)


def _partnered(rows: DataFrame, near) -> DataFrame:
    """Of rows (token, cls, n, early) of tokens of any number of classes, those that some other can be near to. Told by the different sizes of
    each token's sets, which are few and counted before they are shuffled: of a pair, the smaller set has the token early."""
    order = Window.partitionBy("token").orderBy("n")  # a row a size
    sizes = rows.groupBy("token", "n").agg(F.count("*").alias("c"), F.count_if("early").alias("e"))
    sizes = sizes.withColumns({"smaller": F.max(F.when(F.col("e") > 0, F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), "larger": F.lead("n").over(order)})
    any_ = near(F.col("smaller"), F.col("n")) | ((F.col("e") > 0) & (F.col("c") > 1))
    first = (F.col("c") > 1) | near(F.col("n"), F.col("larger"))
    kept = materialize(sizes.select("token", "n", any_.alias("any_"), first.alias("first_")).where("any_ or first_"), "sizes")
    return rows.join(kept, ["token", "n"]).where("any_ or (early and first_)").select("token", "cls", "n")


def _joined(docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(sets: doc_id, h, n, cls of every row; members: cls, doc_id, h of the row that stands for each class, and root, its component)."""
    if not 1 <= percent <= 99:
        raise ValueError(f"percent is from 1 to 99, not {percent}")
    made = _sets(docs, doc_id, text, k, percent, frequent_tokens(docs, text, k))
    stand = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("s")
    classes = made.where("cls is not null").groupBy("cls").agg(stand, *(F.any_value(x).alias(x) for x in ("n", "bits", "first", "hot")))
    classes = materialize(classes.select("cls", "s.doc_id", "s.h", "n", "bits", "first", "hot"), "classes")
    sets = materialize(made.select("doc_id", "h", "n", "cls"), "rows")
    discard(made)

    # Blocks of rare tokens: few classes each, gathered by token.
    at_most = F.col("n") - F.expr(f"({2 * percent} * n + {99 + percent}) div {100 + percent}")  # places of the smaller set's first common token
    # Tokens are counted first, a row a token and task, so that a token of many classes goes another way before anything is gathered by it.
    counts = classes.select(F.explode("first").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    many = materialize(counts.where(F.col("n") > CELL).select("token"), "large-tokens")
    every = classes.select("cls", "n", F.posexplode("first").alias("place", "token")).select("token", "cls", "n", (F.col("place") <= at_most).alias("early"))
    pairs = every.join(many, "token", "left_anti").repartition("token")
    order = Window.partitionBy("token").orderBy("n", "cls")
    near = lambda less, more: F.coalesce(100 * less >= percent * more, F.lit(False))
    seen = pairs.withColumns({
        "before": F.lag("n").over(order),
        "after": F.lead("n").over(order),
        "early_n": F.max(F.when(F.col("early"), F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, -1)),
    }).withColumn("run", F.sum(F.when(near(F.col("before"), F.col("n")), 0).otherwise(1)).over(order))
    partnered = near(F.col("early_n"), F.col("n")) | (F.col("early") & near(F.col("n"), F.col("after")))
    small = materialize(seen.where(partnered).select(F.xxhash64("token", "run").alias("cell"), "cls"), "shared")
    large = _partnered(every.join(many, "token", "left_semi"), near)
    small = small.join(_same_blocks_once(small, "cell"), "cell", "left_semi")
    small = small.select(F.xxhash64(F.lit("small"), "cell").alias("cell"), F.lit(0).alias("side"), "cls", F.lit(None).cast("long").alias("grp"))

    # Blocks of frequent tokens, and others beyond CELL classes: of any size, so never gathered whole.
    # Sets that can reach each other are of one level of sizes or of two that follow each other.
    often = classes.select(F.explode("hot").alias("token"), "cls", "n").unionByName(large)
    level = F.floor(F.ln("n") / (1.0001 * math.log(100 / percent))).cast("int")
    levels = often.select(F.explode(F.array(level, level + 1)).alias("level"), "token", "cls").select(F.xxhash64("token", "level").alias("token"), "cls")
    hot = materialize(levels, "hot")
    several = hot.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    hot = materialize(hot.join(several.select("token"), "token", "left_semi"), "several")
    links = None
    grouped = hot.withColumn("grp", F.col("cls"))
    for _ in range(PIVOTS):
        sizes = grouped.groupBy("token", "grp").agg(F.count("*").alias("n"))
        top = sizes.groupBy("token").agg(F.max_by("grp", F.struct("n", "grp")).alias("top"), F.count("*").alias("groups"), F.sum("n").alias("all"))
        busy = materialize(top.where((F.col("groups") > 1) & (F.col("all") > CELL)).select("token", "top"), "busy")
        if busy.isEmpty():
            break
        within = grouped.join(busy, "token")
        pivots = within.where((F.col("grp") != F.col("top")) | (F.col("cls") == F.col("grp"))).groupBy("token").agg(F.min("cls").alias("pivot"))
        trial = materialize(within.join(pivots, "token").where("cls <> pivot").select("pivot", "cls").distinct(), "trial")
        cell = F.xxhash64("pivot", F.pmod(F.xxhash64("cls"), F.lit(64)))
        none = F.lit(None).cast("long").alias("grp")
        star = trial.select(cell.alias("cell"), F.lit(1).alias("side"), "cls", none).unionByName(trial.select(cell.alias("cell"), F.lit(0).alias("side"), F.col("pivot").alias("cls"), none).distinct())
        found = materialize(_links(materialize(star, "star"), classes, docs, doc_id, text, k, percent), "star-links")
        links = found if links is None else links.unionByName(found)
        grouped = materialize(hot.join(components(links), F.col("cls") == F.col("node"), "left").select("cls", "token", F.coalesce("root", "cls").alias("grp")), "grouped")
    left = grouped.join(_same_blocks_once(grouped, "token"), "token", "left_semi")
    cells = materialize(small.unionByName(_cells(left)), "cells")
    found = _links(cells, classes, docs, doc_id, text, k, percent)
    roots = materialize(components(found if links is None else found.unionByName(links)), "roots")

    members = classes.select("cls", "doc_id", "h").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "doc_id", "h", F.coalesce("root", "cls").alias("root"))
    return sets.select("doc_id", "h", "n", "cls"), members


def join(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    sets, members = _joined(docs, k, percent, doc_id, text)
    names = members.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = members.join(names, "root").select("cls", "component_id")
    out = sets.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least id. Rows with an empty set all stay."""
    sets, members = _joined(docs, k, percent, doc_id, text)
    first = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("s")).select("s.doc_id", "s.h")
    first = materialize(first, "first")
    rows = sets.where("cls is not null").groupBy("doc_id", "h").agg(F.count("*").alias("rows"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])
    gone = materialize(rows.join(first, same(rows, first), "left_anti").select("doc_id", "h"), "copies")
    twice = materialize(rows.where("rows > 1").join(first, same(rows, first), "left_semi").select("doc_id", "h"), "twice")
    own_id, own_h = free(docs.columns, "__id", "__h")
    keyed = docs.withColumns({own_id: docs[f"`{doc_id}`"], own_h: F.xxhash64(docs[f"`{text}`"])})
    on = lambda b: keyed[own_id].eqNullSafe(b["doc_id"]) & (keyed[own_h] == b["h"])
    kept = keyed.join(gone.hint("shuffle_hash"), on(gone), "left_anti")
    if not twice.isEmpty():
        several = keyed.join(twice, on(twice), "left_semi").dropDuplicates([own_id, own_h])
        kept = kept.join(twice, on(twice), "left_anti").unionByName(several)
    return kept.drop(own_id, own_h)
