"""N-gram Jaccard join: prefix-tree join over globally ordered shingle sets, and the components of its links.

A document's set: its distinct 5-word shingles as 64-bit hashes. Two sets link if 100 |x & y| >= 80 |x | y|.

1. Equal sets make a class (by 128-bit signature); its least doc_id stands for it from here on.
2. Document frequencies of all shingles over the classes are counted by an exchange of sorted runs: a chunk sends each
   of its shingles once, whatever its frequency. They give the global order: by the logarithm of the frequency, then
   by hash, so that rare shingles lead. A class of which over a fifth of the shingles occur nowhere else links with
   nothing and leaves.
3. Two linked sets share a shingle among the first |x| - ceil(0.8 |x|) + 1 of each. Those shingles are the first
   branches of the prefix tree. Branches that hold the same classes are one: the first in the global order stays, as
   two sets' overlap counts from the first shingle that they share. Rows of frequent shingles are joined by (shingle,
   salt), so that no task meets all of them.
4. First each class meets the least class of most of its branches, which joins a group of near copies in as many
   comparisons as it has members. What is met by one class stands in tries of at most ``BLOCK_SETS`` sets.
5. Each branch on which several components are left is joined as a whole: the classes' shingles from the branch's on
   form a trie, which all of them walk. What sets share in front is counted once, and a subtree ends as soon as no set in
   it can still reach the overlap it needs, or all are of the walker's component. A branch of many sets is cut into
   blocks, and each pair of blocks is a task. Only links that join components come out, not pairs.

The number of rounds is fixed, but for the components' own, which grow with the logarithm of their size.

Defined results: words are runs of bytes other than space and 9 to 13, A-Z lower-cased; a document of fewer than five
words has one shingle, its whole sequence; null or wordless texts have no shingles, link with nothing and are their
own component. Rows that repeat an id are judged each by its own text; rows without an id take no part and have a null
component. Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linemill.llm._common import release, reliable, without
from linemill.llm._repeats import BUCKET, CHUNK, REPLIES, RUNS, _replies, _runs_of, answers, grown, run_rows, spread, unpack
from linemill.llm._tokens import NOT_SPACE, U, Words, flat, grams, mix, slices, trim

SHINGLE, PERCENT = 5, 80
#: Sets and shingles of a trie at most (a pair of blocks holds twice as many); tasks over which a shingle's rows go.
BLOCK_SETS, BLOCK_SHINGLES, SALTS = 256, 1 << 19, 32


def shingle_sets(column: pa.ChunkedArray | pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, one text after another; where each text's begin."""
    data, at = flat(column)
    words = Words(data, at, NOT_SPACE)
    counts = np.diff(words.of_text)
    long = grams(words.hash, k)
    fits = np.flatnonzero((np.arange(len(long)) + k) <= words.last()[: len(long)])
    text = words.text_of()
    owners, hashes = [text[fits]], [long[fits]]
    for n in range(1, k):
        few = np.flatnonzero(counts == n)
        if len(few):
            owners.append(few)
            hashes.append(mix(grams(words.hash, n)[words.of_text[few]] + U(n)))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
    owner, h = owner[new], h[new]
    return h, np.searchsorted(owner, np.arange(len(counts) + 1))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            h, at = shingle_sets(part["text"])
            sums = [np.concatenate((np.zeros(1, U), np.cumsum(mix(h + U(salt)), dtype=U))) for salt in (1, 2)]
            a, b = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
            yield pa.record_batch([part["doc_id"], part["_lm_key"], pa.array(np.diff(at), pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "_lm_key", "n", "sig_a", "sig_b"])


def _wanted(texts: pa.Table, keep: pa.Table) -> pa.Table:
    """The rows of a chunk that stand for their classes, with column rep; one row of a class."""
    rep = {(r["doc_id"], r["_lm_key"]): r["rep"] for r in keep.select(["doc_id", "_lm_key", "rep"]).to_pylist()}
    rows, reps = [], []
    for i, key in enumerate(zip(texts["doc_id"].to_pylist(), texts["_lm_key"].to_pylist(), strict=True)):
        if (found := rep.pop(key, None)) is not None:
            rows.append(i)
            reps.append(found)
    return texts.take(pa.array(rows, pa.int64())).append_column("rep", pa.array(reps, pa.int64()))


def _frequency_runs(texts: pa.Table, keep: pa.Table, buckets: int) -> pa.Table:
    if not texts.num_rows or not keep.num_rows:
        return run_rows(0, np.zeros(0, U), 64, buckets)
    mine = _wanted(texts, keep)
    h = np.concatenate([shingle_sets(p["text"])[0] >> U(FREQ_SHIFT) for p in slices(mine, "text", 2 << 20)] or [np.zeros(0, U)])
    h.sort()
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    count = np.minimum(np.diff(np.append(at, len(h))), 255).astype(np.uint8)
    state = mine.select(["doc_id", "_lm_key", "rep"]).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, state.schema) as out:
        out.write_table(state)
    return run_rows(texts[CHUNK][0].as_py(), h[at], 64 - FREQ_SHIFT, buckets, c=count, state=sink.getvalue().to_pybytes())


#: Frequencies are counted for the upper 48 bits of a shingle's hash: a clash only makes a shingle look more frequent,
#: and the order is the same for all sets in any case.
FREQ_SHIFT = 16


def _frequency_classes(table: pa.Table) -> pa.Table:
    """For each entry the logarithm of its frequency over all chunks: 0 for one that occurs once."""
    bucket, runs, echo = _runs_of(table)
    if not runs:
        return _replies(echo)
    keys = np.concatenate([unpack(r["a"]) for r in runs])
    count = np.concatenate([np.frombuffer(r["c"], np.uint8) for r in runs]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    total = np.add.reduceat(count[order], first)
    answer = np.empty(len(keys), np.uint8)
    answer[order] = np.repeat(np.ceil(np.log2(total)).astype(np.uint8), np.diff(np.append(first, len(keys))))
    at = np.cumsum([0] + [r["n"] for r in runs])
    return _replies([(r[CHUNK], bucket, answer[at[i] : at[i + 1]].tobytes(), None) for i, r in enumerate(runs)] + echo)


_SETS = "rep long, n int, at int, tokens binary, prefix array<long>"


def _ordered_sets(texts: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """Of each class that may link: its shingles that occur elsewhere too, in the global order (as bytes), the number
    ``n`` of all its shingles and ``at`` of those left out in front, and the shingles of its prefix."""
    out: dict[str, list] = {"rep": [], "n": [], "at": [], "tokens": [], "prefix": []}
    state = next((r["state"] for r in replies.to_pylist() if r["state"]), None)
    if texts.num_rows and state:
        mine = _wanted(texts, pa.ipc.open_stream(state).read_all())
        parts = [(p["rep"].to_numpy(), *shingle_sets(p["text"])) for p in slices(mine, "text", 2 << 20)]
        keys = np.unique(np.concatenate([h >> U(FREQ_SHIFT) for _, h, _ in parts] or [np.zeros(0, U)]))
        rarity = answers(replies, False, np.diff(spread(keys, 64 - FREQ_SHIFT, buckets)))
        for reps, h, at in parts:
            cls = rarity[np.searchsorted(keys, h >> U(FREQ_SHIFT))] if len(h) else np.zeros(0, np.uint8)
            for rep, lo, hi in zip(reps, at[:-1], at[1:], strict=True):
                n = int(hi - lo)
                alone = int((cls[lo:hi] == 0).sum())
                spare = n - -(-PERCENT * n // 100)
                if n == 0 or alone > spare:
                    continue
                order = np.lexsort((h[lo:hi], cls[lo:hi]))[alone:]
                tokens = h[lo:hi][order]
                out["rep"].append(int(rep))
                out["n"].append(n)
                out["at"].append(alone)
                out["tokens"].append(pack_tokens(tokens, cls[lo:hi][order]))
                out["prefix"].append(tokens[: spare + 1 - alone].view(np.int64).tolist())
    return pa.table({"rep": pa.array(out["rep"], pa.int64()), "n": pa.array(out["n"], pa.int32()), "at": pa.array(out["at"], pa.int32()), "tokens": pa.array(out["tokens"], pa.binary()), "prefix": pa.array(out["prefix"], pa.list_(pa.int64()))})


def pack_tokens(tokens: np.ndarray, cls: np.ndarray) -> bytes:
    """Order keys: the class in the upper byte, so that plain integer order is the global order. 56 bits of hash stay."""
    return (cls.astype(U) << U(56) | tokens >> U(8)).tobytes()


class Trie:
    """Ordered sets under shared prefixes. ``walk`` finds those of enough overlap with a probe, and prunes."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], comps: list[int] | None = None):
        """``sizes``: of the whole sets, of which ``sets`` may be only the ends; ``comps``: numbers of components."""
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.sets, self.sizes = [sets[i] for i in self.order], np.array([sizes[i] for i in self.order], np.int64)
        self.comps = np.array([comps[i] for i in self.order], np.int64) if comps else np.arange(len(sets))
        self.nodes: list[tuple] = []  # (ends here, least size, longest rest, component or -1, children)
        self.paths: list[np.ndarray] = []
        if sets:
            self._grow()
        tokens = np.concatenate(self.paths) if self.paths else np.zeros(0, U)
        self.known, self.ids = np.unique(tokens, return_inverse=True)
        self.cut = np.cumsum([0] + [len(p) for p in self.paths])
        self.last = np.array([p[-1] if len(p) else 0 for p in self.paths], U)

    def _grow(self) -> None:
        todo = [(0, len(self.sets), 0, -1)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            a, b = self.sets[lo], self.sets[hi - 1]
            least = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:least] != b[depth:least])
            upto = depth + int(differ[0]) if len(differ) else least
            one = int(self.comps[lo]) if (self.comps[lo:hi] == self.comps[lo]).all() else -1
            rest = max(len(self.sets[i]) for i in range(lo, hi)) - upto
            start = lo
            while start < hi and len(self.sets[start]) == upto:  # sets that end here come first
                start += 1
            self.paths.append(a[depth:upto])
            self.nodes.append((range(lo, start), int(self.sizes[lo:hi].min()), rest, one, []))
            if parent >= 0:
                self.nodes[parent][-1].append(len(self.nodes) - 1)
            me = len(self.nodes) - 1
            for i in range(start + 1, hi + 1):
                if i == hi or self.sets[i][upto] != self.sets[start][upto]:
                    todo.append((start, i, upto, me))
                    start = i

    def walk(self, probe: np.ndarray, size: int, comp: int = -1) -> Iterator[int]:
        """Indices of the sets, but those of component ``comp``, whose Jaccard with the probe (of ``size`` shingles in
        all) is high enough."""
        if not self.nodes:
            return
        met = np.zeros(len(self.known) + 1, np.int32)
        at = np.searchsorted(self.known, probe)
        met[at[self.known[np.minimum(at, len(self.known) - 1)] == probe] if len(self.known) else at[:0]] = 1
        seen = np.concatenate(([0], np.cumsum(met[self.ids])))
        shared = (seen[self.cut[1:]] - seen[self.cut[:-1]]).tolist()  # of each path, however many sets go through it
        # The probe's shingles that order behind a node are all that can still be met.
        behind = (len(probe) - np.searchsorted(probe, self.last, side="right")).tolist()
        todo = [(0, 0)]
        while todo:
            node, overlap = todo.pop()
            ends, least, rest, one, children = self.nodes[node]
            if one == comp and comp >= 0:
                continue
            overlap += shared[node]
            if overlap + min(behind[node], rest) < _needed(size, least):
                continue
            for i in ends:
                if overlap >= _needed(size, int(self.sizes[i])) and (comp < 0 or self.comps[i] != comp):
                    yield self.order[i]
            todo += [(c, overlap) for c in children]


def _needed(n: int, m: int) -> int:
    return -(-PERCENT * (n + m) // (100 + PERCENT))  # 100 o >= 80 (n + m - o)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x[0] for x in pairs], pa.int64()), "b": pa.array([x[1] for x in pairs], pa.int64())}, schema=_LINKS)


def _star(others: pa.Table, pivots: pa.Table) -> pa.Table:
    """(pivot, other) that link: the pivot walks a trie of what is to meet it."""
    if not others.num_rows or not pivots.num_rows:
        return _linked([])
    rows, pivot = others.to_pydict(), pivots.slice(0, 1).to_pylist()[0]
    trie = Trie([np.frombuffer(x, U) for x in rows["tokens"]], rows["n"])
    return _linked([(pivot["p"], rows["other"][i]) for i in trie.walk(np.frombuffer(pivot["p_tokens"], U), pivot["p_n"])])


def _branch(table: pa.Table) -> pa.Table:
    """Links between components on one branch, or between two blocks of it; enough of them to join what links."""
    rows = table.sort_by([("rep", "ascending")]).to_pydict()
    sets = [np.frombuffer(x, U) for x in rows["tokens"]]
    names = {c: i for i, c in enumerate(dict.fromkeys(rows["comp"]))}
    comps = [names[c] for c in rows["comp"]]
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    trie, out = Trie(sets, rows["n"], comps), []
    for i, probe in enumerate(sets):
        for j in trie.walk(probe, rows["n"][i], comps[i]):
            a, b = find(comps[i]), find(comps[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((rows["rep"][i], rows["rep"][j]))
    return _linked(out)


def _stars(links: DataFrame) -> DataFrame:
    """(a, comp): the least node that links (a, b) reach from a, of all that reach a lesser one.

    Alternating large-star and small-star rounds, until every node hangs on one root. Each round is a few shuffles of the
    links; their number falls to one a node, and the rounds grow with the logarithm of a component's size.
    """
    edges = reliable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while not edges.isEmpty():
        # Large star: every neighbour above u joins the least of u's neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: u and its neighbours below join the least of them.
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(m.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges = reliable(small)
        release(edges.sparkSession)
        # Stars: no root hangs on another, no node on two.
        several = edges.groupBy("a").count().where("count > 1").select("a").limit(1)
        if edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a").limit(1).unionByName(several).isEmpty():
            break
    return edges.select("a", F.col("b").alias("comp"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp): the least node that links (a, b) reach; nodes without links stay themselves."""
    found = _stars(links)
    return nodes.join(found, nodes["node"] == found["a"], "left").select("node", F.coalesce("comp", "node").alias("comp"))


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, comp) after further links: only the components that these touch are joined anew."""
    named = comp.select(F.col("node").alias("x"), F.col("comp").alias("c"))
    one = links.join(named, F.col("a") == F.col("x")).select(F.col("c").alias("ca"), "b")
    both = one.join(named, F.col("b") == F.col("x")).select(F.col("ca").alias("a"), F.col("c").alias("b"))
    found = _stars(both).select("a", F.col("comp").alias("least"))
    return reliable(comp.join(found, comp["comp"] == found["a"], "left").select("node", F.coalesce("least", "comp").alias("comp")))


def jaccard_components(docs: DataFrame, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, _lm_key) of each row of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_lm_key"), F.col("text").cast("string").alias("text"))
    signed = reliable(rows.mapInArrow(_signatures, "doc_id long, _lm_key long, n long, sig_a long, sig_b long"))
    least = F.min(F.struct(F.col("doc_id").alias("rep"), "_lm_key")).alias("least")
    classes = signed.where("n > 0 and doc_id is not null").groupBy("n", "sig_a", "sig_b").agg(least)
    classes = reliable(classes.select("n", "sig_a", "sig_b", F.col("least.rep").alias("rep"), F.col("least._lm_key").alias("_lm_key")))
    total = int(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)
    chunk_bytes, buckets = grown(total, chunk_bytes)
    chunks = max(1, -(-total // chunk_bytes))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks)).cast("int").alias(CHUNK)
    dealt = rows.where("doc_id is not null").select(place("doc_id"), "doc_id", "_lm_key", "text").repartition(chunks, CHUNK)
    keep = classes.select(place("rep"), F.col("rep").alias("doc_id"), "_lm_key", "rep")
    frequency, ordered, classes_of = trim(_frequency_runs), trim(_ordered_sets), trim(_frequency_classes)
    runs = dealt.groupBy(CHUNK).cogroup(keep.groupBy(CHUNK)).applyInArrow(lambda t, r: frequency(t, r, buckets), RUNS)
    replies = runs.groupBy(BUCKET).applyInArrow(lambda t: classes_of(t), REPLIES)
    sets = reliable(dealt.groupBy(CHUNK).cogroup(replies.groupBy(CHUNK)).applyInArrow(lambda t, r: ordered(t, r, buckets), _SETS))
    comp = _links(sets)
    named = classes.join(comp, classes["rep"] == comp["node"], "left").select("n", "sig_a", "sig_b", F.coalesce("comp", "rep").alias("comp"))
    done = signed.join(named, ["n", "sig_a", "sig_b"], "left")
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"), "_lm_key")


def _salted(posting: DataFrame, info: DataFrame) -> DataFrame:
    """posting (token, salt, ...) with the columns of info (token, ...), one row a token. What is known of a token goes to
    its salts first, so that the rows of a frequent one meet it in many tasks."""
    return posting.join(posting.select("token", "salt").distinct().join(info, "token"), ["token", "salt"])


def _links(sets: DataFrame) -> DataFrame:
    """(node, comp) of the sets: the least rep that links reach.

    ``m``: of a class on a branch, its shingles from the branch's on; two classes of which the branch is the first that
    they share overlap in no more than the lesser m, so only pairs of a fitting m are compared there.
    """
    content = sets.select("rep", "n", "tokens")
    posting = sets.select("rep", "n", "at", F.posexplode("prefix").alias("i", "token"))
    posting = posting.select("token", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).alias("salt"), "rep", "n", "i", (F.col("n") - F.col("at") - F.col("i")).alias("m"))
    mark = [F.bit_xor(F.xxhash64(F.lit(k), "rep")).alias(f"mark{k}") for k in (1, 2)]  # of the classes on a branch
    shared = posting.groupBy("token").agg(F.count("*").alias("c"), *mark, F.sum("m").alias("whole"), F.min(F.struct("rep", "n", "m")).alias("first")).where("c > 1")
    # Of branches that hold the same classes the first in the global order has the longest rest of each.
    alike = shared.groupBy("c", "mark1", "mark2").agg(F.max(F.struct("whole", "token", "first")).alias("kept"), F.count("*").alias("alike"))
    kept = alike.select("kept.token", "kept.first", "alike")
    posting = reliable(_salted(posting, kept))
    # First each class meets one partner only: the least class of most of its branches.
    met = posting.where("rep != first.rep").where(_fits("n", "m", "first.n", "first.m"))
    best = met.groupBy(F.col("first.rep").alias("pivot"), F.col("rep").alias("other")).agg(F.sum("alike").alias("c")).groupBy("other").agg(F.max(F.struct("c", (-F.col("pivot")).alias("minus"))).alias("b"))
    comp = reliable(components(sets.select(F.col("rep").alias("node")).distinct(), _compared(best.select((-F.col("b.minus")).alias("pivot"), "other"), content)))
    release(comp.sparkSession)
    # A branch is open while it holds several components that may link there.
    placed = posting.drop("first", "alike").join(comp, posting["rep"] == comp["node"]).drop("node")
    for _ in range(2):
        tally = placed.groupBy("token").agg(F.min("n").alias("least_n"), F.max("m").alias("most_m"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        placed = _salted(placed, tally).where(_fits("n", "m", "least_n", "most_m", False)).drop("least_n", "most_m", "low", "high")
    placed = reliable(placed)
    sized = placed.groupBy("token").agg(F.count("*").alias("rows"), F.sum("m").alias("whole"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_SETS), F.ceil(F.col("whole") / BLOCK_SHINGLES)).cast("int")
    cut = _salted(placed, sized.select("token", blocks.alias("blocks"))).withColumn("block", F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("blocks")).cast("int"))
    # Each block meets itself and every other: a row goes to one task for each block of its branch.
    first, second = F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", first, second, "rep", "n", "i", "comp")
    named = content.select(F.col("rep").alias("r"), "tokens")
    ends = F.substring("tokens", 8 * F.col("i") + 1, F.octet_length("tokens"))
    full = dealt.join(named, dealt["rep"] == named["r"]).select("token", "first", "second", "rep", "n", "comp", ends.alias("tokens"))
    branch = trim(_branch)
    links = reliable(full.groupBy("token", "first", "second").applyInArrow(lambda t: branch(t), "a long, b long").distinct())
    return comp if links.isEmpty() else _merged(comp, links)


def _fits(n: str, m: str, n2: str, m2: str, sizes: bool = True) -> str:
    """Whether two sets can still overlap enough; with ``sizes``, also whether their sizes allow it at all."""
    by_size = f" and 100L * least({n}, {n2}) >= {PERCENT}L * greatest({n}, {n2})" if sizes else ""
    return f"{100 + PERCENT}L * least({m}, {m2}) >= {PERCENT}L * ({n} + {n2}){by_size}"


def _compared(asked: DataFrame, content: DataFrame) -> DataFrame:
    """(a, b): the pairs (pivot, other) that link; each set is sent once, a pivot's once for each ``BLOCK_SETS`` others."""
    asked = reliable(asked)
    often = asked.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("parts"))
    # A pivot that many meet is spread before it meets its own row.
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(SALTS)))
    many = asked.select("pivot", "salt").distinct().join(often, "pivot")
    others = asked.join(many, ["pivot", "salt"]).select("pivot", F.pmod(F.xxhash64(F.lit(6), "other"), F.col("parts")).cast("int").alias("part"), "other")
    others = others.join(content.withColumnRenamed("rep", "other"), "other")
    whole = content.select(F.col("rep").alias("r"), F.col("n").alias("p_n"), F.col("tokens").alias("p_tokens"))
    pivots = often.select(F.col("pivot").alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p_part")).join(whole, F.col("p") == F.col("r")).drop("r")
    star = trim(_star)
    return reliable(others.groupBy("pivot", "part").cogroup(pivots.groupBy("p", "p_part")).applyInArrow(lambda o, p: star(o, p), "a long, b long"))


def jaccard_report(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that name their component; of rows that repeat such an id and its text one, and all without an id."""
    found = jaccard_components(docs)
    kept = without(docs, found.where("component_id <> doc_id"))
    again = found.groupBy("doc_id", "_lm_key").count().where("count > 1 and doc_id is not null").limit(1).count()
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).union(kept.where("doc_id is null")) if again else kept
