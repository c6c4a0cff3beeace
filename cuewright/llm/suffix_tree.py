"""Operator 10, language-model scores from a probabilistic suffix tree.

Symbols are the bytes of the text, folded into SYMBOLS classes (a rule, see `CLASS`), and an end symbol. All
training texts are counted: (DEPTH symbols of context, next symbol), and from these the shorter contexts.
A context is retained if its next-symbol distribution diverges from that of its longest retained suffix: count
* KL divergence must exceed DIVERGENCE (a likelihood-ratio test). Distributions are smoothed towards the
suffix's (STRENGTH pseudo-counts). A position is scored by the longest retained suffix of what precedes it,
times the byte's share within its class; the sum over all bytes and the end is the text's log10 probability.

The contexts seen and retained grow with the corpus (of SYMBOLS^DEPTH, 8 * 10^9, possible ones). Contexts of up to
two symbols are tested at the driver, over at most SYMBOLS^3 counts. Deeper ones are counted by a shuffle and tested in
groups that share their last three symbols, at most SYMBOLS^4 rows each. Tasks hold all retained ones of three symbols
and the at most CONTEXTS most frequent deeper ones. Of the rarer ones they hold a filter of FILTER bits: only positions
that it lets through (those under a rarer context, and a few more) are written, as packed columns of (document, run of
symbols) pairs. These are brought together with the rarer contexts in groups of about GROUP contexts or PAIRS pairs.

The base score needs the count of every word in the training texts, a table that grows with the corpus. Only
at most HOT words, the most frequent ones by a histogram of counts, are held by the tasks; tokens of other words are summed per (document, word) and
joined with the full counts by shuffle. Words are keyed by 64-bit hashes.

Defined cases: a null text counts as empty (one token, the end); the crc of a null doc_id is that of
the empty text, so such a row is held out; repeated rows count and are scored each; without any
training text the smoothing alone decides; an empty table gives an empty result. Very long texts are read whole. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, give_back, stage

HOT, CONTEXTS, DEPTH, DIVERGENCE, STRENGTH, ALPHA = 1_000_000, 200_000, 6, 40.0, 8.0, 0.1
#: Bits of the filter; contexts and pairs of a group; pairs that a task gathers before it writes them.
FILTER, GROUP, PAIRS, GATHERED = 1 << 27, 5_000, 2_000_000, 500_000
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _classes() -> tuple[np.ndarray, int]:
    """Class of each byte: the letters a-z, space, line end, digits, A-Z and the other ASCII marks by groups of eight, then non-ASCII bytes by 16."""
    table, names = np.zeros(256, np.int64), {}
    for c in range(256):
        ch = chr(c)
        name = ch if ch in "abcdefghijklmnopqrstuvwxyz \n.," else "0" if c < 128 and ch.isdigit() else "A" if c < 128 and ch.isalpha() else ("mark", c // 32) if c < 128 else ("high", c // 16)
        table[c] = names.setdefault(name, len(names))
    return table, len(names)


CLASS, _N = _classes()
END = _N
SYMBOLS = _N + 1


def symbols_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts in a row, each with DEPTH end symbols before it and one after; the texts' places; which symbols are predicted."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + DEPTH + 1) - sizes - 1
    out = np.full(int((sizes + DEPTH + 1).sum()), END, np.int64)
    predicted = np.ones(len(out), bool)
    for k in range(1, DEPTH + 1):
        predicted[starts - k] = False
    inside = predicted.copy()
    inside[starts + sizes] = False
    out[inside] = CLASS[np.frombuffer(b"".join(texts), np.uint8)]
    return out, starts, predicted


def code_at(s: np.ndarray, first: int, last: int) -> np.ndarray:
    """At every symbol from place DEPTH on: the code of the symbols `first` to `last` places before it, the oldest highest."""
    n = len(s) - DEPTH
    code = np.zeros(n, np.int64)
    for k in range(first, last - 1, -1):
        code *= SYMBOLS
        code += s[DEPTH - k : DEPTH - k + n]
    return code


def codes_of(s: np.ndarray, at: np.ndarray, last: int) -> np.ndarray:
    """`code_at` of the symbols DEPTH to `last` places before, at some places only."""
    code = np.zeros(len(at), np.int64)
    for k in range(DEPTH, last - 1, -1):
        code = code * SYMBOLS + s[DEPTH - k + at]
    return code


def grams_of(texts: list[bytes]) -> np.ndarray:
    """Codes of (DEPTH symbols of context, next) at every predicted position."""
    s, _, predicted = symbols_of(texts)
    return code_at(s, DEPTH, 0)[predicted[DEPTH:]]


def word_hashes(text: bytes) -> np.ndarray:
    words = text.translate(_UPPER).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def raw(value: str | None) -> bytes:
    return (value or "").encode("utf-8", "surrogatepass")


def slices(values: list, size: int = 2 << 20):
    """Runs of list places whose texts come to about `size` bytes."""
    start, held = 0, 0
    for i, v in enumerate(values):
        held += len(v)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(values):
        yield start, len(values)


#: kinds of counted rows: words, symbols after their context, bytes
_WORD, _GRAM, _BYTE = 0, 1, 2


def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (keys, counts) by key."""
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def training_counts(docs: DataFrame) -> DataFrame:
    """kind, key, n over all training texts: each task adds up its own part before the shuffle."""

    def count(batches):
        single = np.zeros(256, np.int64)

        def rows(kind, keys, n):
            for i in range(0, len(keys), 500_000):
                part = keys[i : i + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part, pa.int64()), pa.array(n[i : i + 500_000], pa.int64())], names=["kind", "key", "n"])

        pending, held, grams = [], 0, []
        for batch in batches:
            texts = [raw(t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not is_held_out(d)]
            for a, b in slices(texts):
                part = texts[a:b]
                grams.append(np.unique(grams_of(part), return_counts=True))
                if sum(len(k) for k, _ in grams) > 4_000_000:
                    grams = [merged(grams)]
                    if len(grams[0][0]) > 3_000_000:
                        yield from rows(_GRAM, *grams.pop())
                single += np.bincount(np.frombuffer(b"".join(part), np.uint8), minlength=256)
                hashes = [word_hashes(t) for t in part]
                pending.append(np.concatenate(hashes))
                held += len(pending[-1])
                if held > 6_000_000:
                    yield from rows(_WORD, *np.unique(np.concatenate(pending), return_counts=True))
                    pending, held = [], 0
        if pending:
            yield from rows(_WORD, *np.unique(np.concatenate(pending), return_counts=True))
        if grams:
            yield from rows(_GRAM, *merged(grams))
        keys = np.flatnonzero(single)
        yield from rows(_BYTE, keys, single[keys])

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "kind tinyint, key long, n long")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def depth_of(rows: int) -> int:
    """Number of symbols of which there are so many runs."""
    return round(np.log(rows) / np.log(SYMBOLS))


def build_tree(grams: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """P(next | longest retained suffix) for every context, a row each, of as many symbols as the counted `grams` have before the next one; log10 share of each byte in its class; contexts retained."""
    S, longest = SYMBOLS, depth_of(len(grams)) - 1
    full = grams.reshape((S,) * (longest + 1)).astype(np.float64)
    one = full.sum(axis=tuple(range(longest)))
    dist = (one + 1) / (one.sum() + S)  # the root: add-one
    used, total = dist[None, :], 0
    for depth in range(1, longest + 1):
        counts = full.sum(axis=tuple(range(longest - depth))).reshape(-1, S)
        n = counts.sum(axis=1, keepdims=True)
        parent = np.tile(used, (S, 1)) if depth > 1 else np.repeat(used, S, axis=0)  # the suffix: the context without its oldest symbol
        smooth = (counts + STRENGTH * parent) / (n + STRENGTH)
        with np.errstate(divide="ignore", invalid="ignore"):
            kl = np.where(counts > 0, counts / np.maximum(n, 1) * np.log(counts / np.maximum(n, 1) / parent), 0).sum(axis=1)
        kept = n[:, 0] * kl > DIVERGENCE
        total += int(kept.sum())
        used = np.where(kept[:, None], smooth, parent)
    share = (single + ALPHA) / np.bincount(CLASS, weights=single + ALPHA, minlength=_N)[CLASS]
    return used, np.log10(share), total


def places_in(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def deep_contexts(codes: np.ndarray, n: np.ndarray, short: np.ndarray) -> list[tuple]:
    """(depth, contexts, their counts, their distributions) of the retained contexts of more symbols than those of `short`, up to DEPTH.

    `codes`, `n`: all counted (context, next) with the same last three symbols of context, for one or more such
    endings; `short`: the rows of distributions of `build_tree`, over contexts of two or three symbols.
    """
    S, found, known = SYMBOLS, [], depth_of(len(short))
    grams, used = np.zeros(0, np.int64), np.zeros(0)
    for depth in range(known + 1, DEPTH + 1):
        own, counts = merged([(codes % S ** (depth + 1), n)])
        parent = short[own // S % S**known, own % S] if depth == known + 1 else used[np.searchsorted(grams, own % S**depth)]
        contexts, which = np.unique(own // S, return_inverse=True)
        total = np.bincount(which, counts)
        gain = np.bincount(which, counts * np.log(counts / total[which] / parent))
        kept = gain > DIVERGENCE
        grams, used = own, np.where(kept[which], (counts + STRENGTH * parent) / (total[which] + STRENGTH), parent)
        names = contexts[kept]
        spread = short[names % S**known]
        for d, keys, _, rows in found:
            at, hit = places_in(keys, names % S**d)
            spread[hit] = rows[at[hit]]
        spread *= STRENGTH
        place = np.cumsum(kept) - 1
        of = kept[which]
        spread[place[which[of]], own[of] % S] += counts[of]
        # not as float32: a symbol never seen after a frequent context would have probability 0
        found.append((depth, names, total[kept].astype(np.int64), spread / (total[kept] + STRENGTH)[:, None]))
    return found


def retained(grams: DataFrame, short) -> DataFrame:
    """depth, context, n, spread (log10): every retained context of more than two symbols. `short` is a broadcast of `build_tree`'s rows over two."""

    def test(batches):
        waiting, held = [], 0

        def rows(codes, n):
            for depth, names, total, spread in deep_contexts(codes, n, short.value):
                for i in range(0, len(names), 20_000):
                    part = spread[i : i + 20_000]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * SYMBOLS, pa.int32()), pa.array(np.log10(part).reshape(-1), pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), depth, np.int8)), pa.array(names[i : i + 20_000], pa.int64()), pa.array(total[i : i + 20_000], pa.int64()), lists], names=["depth", "context", "n", "spread"])

        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            held += batch.num_rows
            if held > 500_000:
                codes, n = (np.concatenate(x) for x in zip(*waiting, strict=True))
                ending = codes // SYMBOLS % SYMBOLS**3
                whole = int(np.searchsorted(ending, ending[-1]))  # the last ending may go on
                yield from rows(codes[:whole], n[:whole])
                waiting, held = [(codes[whole:], n[whole:])], 0
        if waiting:
            yield from rows(*(np.concatenate(x) for x in zip(*waiting, strict=True)))

    ending = F.expr(f"key div {SYMBOLS} % {SYMBOLS**3}")
    return grams.repartition(ending).sortWithinPartitions(ending).mapInArrow(test, "depth tinyint, context long, n long, spread array<float>")


def slot_of(depth, contexts: np.ndarray) -> np.ndarray:
    """Bit of the filter for each context of `depth` symbols (one depth or one each)."""
    mixed = (contexts.astype(np.uint64) * np.uint64(8) + np.asarray(depth, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(65 - FILTER.bit_length())).astype(np.int64)


def filter_of(cold: DataFrame) -> np.ndarray:
    """The filter's bytes, with the bit of each context set; other contexts may share it. At most FILTER / 64 rows come to the driver."""

    def mark(batches):
        for batch in batches:
            slots = np.unique(slot_of(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            words, first = np.unique(slots >> 6, return_index=True)
            bits = np.uint64(1) << (slots & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array((np.bitwise_or.reduceat(bits, first) if len(first) else bits).view(np.int64))], names=["key", "n"])

    words = cold.select("depth", "context").mapInArrow(mark, "key long, n long").groupBy("key").agg(F.bit_or("n").alias("n"))
    return dense(words, FILTER // 64).view(np.uint8)


def group_of(ending: str, groups: int) -> str:
    """SQL for the group of contexts and positions with an ending of four symbols; `grouped` does the same for arrays."""
    return f"cast({ending} % {SYMBOLS**4}L * 2654435761L div 65536L % {groups}L as int)"


def grouped(endings: np.ndarray, groups: int) -> np.ndarray:
    return endings % SYMBOLS**4 * 2654435761 // 65536 % groups


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, compressed byte plane by byte plane; the first, in order, by its differences."""
    first, *others = columns
    return pa.compress(b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in (np.diff(first, prepend=0), *others)), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kinds: list) -> list[np.ndarray]:
    """The columns of `packed`, of n values of these kinds."""
    sizes = [np.dtype(k).itemsize for k in kinds]
    planes, at, out = np.frombuffer(pa.decompress(data, n * sum(sizes), "zstd", asbytes=True), np.uint8).reshape(-1, n), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(planes[at : at + size].T).view(kind).reshape(n))
        at += size
    return [np.cumsum(out[0]), *out[1:]]


#: kinds of the columns of pairs: run of symbols, row within its task, times, log10 probability by the held contexts
_PAIR = [np.int64, np.int64, np.int32, np.float32]


def deeper_changes(batches):
    """row_no, change of the score, from rows sorted by group: first the group's contexts, then its packed pairs."""
    group, contexts, tables = None, [], {}
    for batch in batches:
        groups, of_pairs = batch.column("group").to_numpy(), batch.column("pairs").is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]) | (of_pairs[1:] != of_pairs[:-1]), True]) if len(groups) else np.zeros(0, np.int64)
        rows, changes = [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            if groups[a] != group:
                group, contexts, tables = groups[a], [], {}
            if not of_pairs[a]:
                spread = part.column("spread").flatten().to_numpy().reshape(-1, SYMBOLS)
                contexts.append((part.column("depth").to_numpy(), part.column("context").to_numpy(), spread))
                continue
            if contexts:
                depths, names, spread = (np.concatenate(x) for x in zip(*contexts, strict=True))
                for depth in range(4, DEPTH + 1):
                    own = np.flatnonzero(depths == depth)
                    own = own[np.argsort(names[own], kind="stable")]
                    tables[depth] = names[own], spread[own]
                contexts = []
            for base, n, data in zip(part.column("row_no").to_pylist(), part.column("pairs").to_pylist(), part.column("packed").to_pylist(), strict=True):
                grams, row, times, was = unpacked(data, n, _PAIR)
                now, met = was.copy(), np.zeros(n, bool)
                for depth, (names, spread) in tables.items():  # the deepest comes last
                    at, hit = places_in(names, grams // SYMBOLS % SYMBOLS**depth)
                    now[hit] = spread[at[hit], grams[hit] % SYMBOLS]
                    met |= hit
                own, which = np.unique(row[met], return_inverse=True)
                rows.append(own + base)
                changes.append(np.bincount(which, times[met] * (now[met].astype(np.float64) - was[met]), len(own)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(changes))], names=["row_no", "change"])


class Tree:
    """The held contexts of a task as a trie: gathers lead from symbols to the row of the longest one."""

    def __init__(self, short: np.ndarray, three: tuple[np.ndarray, np.ndarray], held: list[tuple[np.ndarray, np.ndarray]], rarer: np.ndarray | None):
        """short: `build_tree`'s rows over two symbols; three: the contexts and log10 rows of depth three; held: the same, sorted, of each depth from four on; rarer: the filter of the contexts that are not held, if there are any."""
        S = SYMBOLS
        first = S**3
        self.rows = np.empty((first + sum(len(keys) for keys, _ in held), S), np.float32)
        self.rows[:first].reshape(S, S * S, S)[:] = np.log10(short)  # the suffix: the context without its oldest symbol
        self.rows[three[0]] = three[1]
        np.concatenate([rows for _, rows in held], out=self.rows[first:])
        self.rows = self.rows.reshape(-1)
        self.steps, self.starts = [], []  # by depth: (next place by place and symbol, row of the place); the first row
        before = np.arange(S**3)
        for depth, (keys, rows) in enumerate(held, 4):
            deeper = [k % S**depth for k, _ in held[depth - 3 :]]
            places = np.unique(np.concatenate([keys, *deeper]))  # held ones and what leads to held ones
            step = np.zeros(len(before) * S + S, np.int32)
            step[np.searchsorted(before, places % S ** (depth - 1)) * S + places // S ** (depth - 1) + (S if depth > 4 else 0)] = np.arange(1, len(places) + 1)
            own = np.zeros(len(places) + 1, np.int32)
            own[1 + np.searchsorted(places, keys)] = first + np.arange(len(keys))
            self.steps.append((step, own))
            self.starts.append(first)
            before, first = places, first + len(keys)
        self.rarer = rarer

    def open_places(self, s: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Places under which the filter has a context deeper than the held one of that row. (A held context's suffixes occur at least as often, so none of them is missing.)"""
        out = [np.zeros(0, np.int64)]
        for i in range(0, len(row), 1 << 18):  # by blocks, so that arrays of codes stay small
            own = row[i : i + (1 << 18)]
            at = np.flatnonzero(own < self.starts[-1])
            own, codes = own[at], codes_of(s, at + i, 1)
            found = np.zeros(len(at), bool)
            for depth, first in enumerate(self.starts, 4):
                slot = slot_of(depth, codes % SYMBOLS**depth)
                found |= (own < first) & (self.rarer[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
            out.append(at[found] + i)
        return np.concatenate(out)

    def score(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of every symbol from place DEPTH on; places among them under which a rarer context may be retained."""
        n = len(s) - DEPTH
        ending = code_at(s, 3, 1)
        row, place = ending.copy(), ending
        for depth, (step, own) in enumerate(self.steps, 4):
            # place 0 is none; at depth four every ending of three symbols is a place
            place = step[place * SYMBOLS + s[DEPTH - depth : DEPTH - depth + n]].astype(np.int64)
            deeper = own[place]
            np.copyto(row, deeper, where=deeper > 0)
        open_ = np.zeros(0, np.int64) if self.rarer is None else self.open_places(s, row)
        row *= SYMBOLS
        row += s[DEPTH:]
        return self.rows[row], open_


def size_class(n):
    """Column: sixteenths of a power of two."""
    return F.floor(F.log2(n) * 16).cast("int")


def hot_cut(words: DataFrame, hot: int) -> int:
    """The lowest size class from which on there are at most `hot` words."""
    seen, cut = 0, 1 << 30
    for r in words.groupBy(size_class(F.col("n")).alias("size")).count().orderBy(F.desc("size")).collect():  # at most 16 * 63 rows
        seen += r["count"]
        if seen > hot:
            break
        cut = r["size"]
    return cut


def dense(counts: DataFrame, size: int) -> np.ndarray:
    """n of (key, n) by key: at most `size` rows."""
    out, got = np.zeros(size, np.int64), counts.toArrow()
    out[got["key"].to_numpy()] = got["n"].to_numpy()
    return out


def sorted_rows(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The two columns of df by the first."""
    got = df.toArrow()
    order = np.argsort(keys := got.column(0).to_numpy(), kind="stable")
    return keys[order], got.column(1).to_numpy()[order]


def context_rows(tree: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of one depth in order, and their distributions."""
    got = tree.select("context", "spread").toArrow().combine_chunks()
    order = np.argsort(keys := got["context"].to_numpy(), kind="stable")
    rows = got["spread"].combine_chunks().flatten().to_numpy().reshape(-1, SYMBOLS) if len(keys) else np.zeros((0, SYMBOLS), np.float32)
    return keys[order], rows[order]


def score_documents(docs: DataFrame, hot: int = HOT, contexts: int = CONTEXTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs."""
    spark = docs.sparkSession
    arrow_limits(spark)
    counts = stage(training_counts(docs), "suffix-counts")
    words = counts.filter(F.col("kind") == _WORD).select("key", "n")
    facts = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"))

    def trained(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(not is_held_out(d) for d in batch.column(0).to_pylist())], pa.int64())], names=["n"])

    ends = texts.mapInArrow(trained, "n long").agg(F.sum("n")).first()[0] or 0
    total, distinct = (facts["n"] or 0) + ends, facts["v"] + (1 if ends else 0)
    deep = counts.filter(F.col("kind") == _GRAM).select("key", "n")
    pairs = dense(deep.groupBy((F.col("key") % SYMBOLS**3).alias("key")).agg(F.sum("n").alias("n")), SYMBOLS**3)
    short, share, _ = build_tree(pairs, dense(counts.filter(F.col("kind") == _BYTE).select("key", "n"), 256))
    sent = spark.sparkContext.broadcast(short)
    tree = stage(retained(deep, sent), "suffix-contexts")
    sent.destroy()
    longer = tree.filter(F.col("depth") > 3)
    held_from = hot_cut(longer, contexts)
    cold = longer.filter(size_class(F.col("n")) < held_from)
    left = cold.agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("pairs")).first()
    groups = 1 + max(left["contexts"] // GROUP, (left["pairs"] or 0) // PAIRS)
    model = spark.sparkContext.broadcast({
        "short": short, "share": share, "rarer": filter_of(cold) if left["contexts"] else None, "three": context_rows(tree.filter(F.col("depth") == 3)),  # at most SYMBOLS^3 rows
        "held": [context_rows(longer.filter((F.col("depth") == d) & (size_class(F.col("n")) >= held_from))) for d in range(4, DEPTH + 1)],  # at most `contexts` rows in all
        "words": sorted_rows(words.filter(size_class(F.col("n")) >= hot_cut(words, hot)).select("key", "n")),  # at most `hot` rows
    })
    give_back()
    bottom = np.log10(total + ALPHA * (distinct + 1))
    end_score = float(np.log10(ends + ALPHA) - bottom)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int64())]))]
    names = ["row_no", "doc_id", "n_tokens", "n_hot", "hot_sum", "score", "rare", "group", "pairs", "packed"]

    def score(batches):
        m = model.value
        tree = Tree(m["short"], m["three"], m["held"], m["rarer"])
        keys, n = m["words"]
        logs = np.log10(n + ALPHA)
        seq, part = 0, TaskContext.get().partitionId()
        pairs, gathered = [], 0

        def written():
            """The gathered pairs, a row for each group."""
            grams, row, times, was = (np.concatenate(x) for x in zip(*pairs, strict=True))
            group = grouped(grams // SYMBOLS, groups)
            order = np.lexsort((row, grams, group))
            group = group[order]
            edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            data = [packed(*(x[order[a:b]].astype(k) for x, k in zip((grams, row, times, was), _PAIR, strict=True))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            rest = [pa.nulls(len(data), k) for k in kinds[1:]]
            return pa.RecordBatch.from_arrays([pa.array([part << 40] * len(data), pa.int64()), *rest, pa.array(group[edges[:-1]], pa.int32()), pa.array(np.diff(edges), pa.int32()), pa.array(data, pa.binary())], names=names)

        for batch in batches:
            ids, values = batch.column(0).to_pylist(), [raw(t) for t in batch.column(1).to_pylist()]
            for a, b in slices(values):
                part_texts = values[a:b]
                s, starts, predicted = symbols_of(part_texts)
                p, open_at = tree.score(s)
                p = np.where(predicted[DEPTH:], p, 0)
                sums = np.add.reduceat(p, starts - DEPTH, dtype=np.float64)
                open_at = open_at[predicted[DEPTH:][open_at]]
                if len(open_at):
                    row, step = np.searchsorted(starts - DEPTH, open_at, "right") - 1, len(part_texts)  # runs of symbols times rows stay below 2^63
                    both, where, times = np.unique(codes_of(s, open_at, 0) * step + row, return_index=True, return_counts=True)
                    pairs.append((both // step, both % step + seq, times, p[open_at[where]]))
                    gathered += len(both)
                out: list[list] = [[] for _ in range(7)]
                for i, text in enumerate(part_texts):
                    h = word_hashes(text)
                    inside = float(m["share"] @ np.bincount(np.frombuffer(text, np.uint8), minlength=256))
                    at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                    hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                    rare, times = np.unique(h[~hit], return_counts=True)
                    base = float(logs[at[hit]].sum()) if hit.any() else 0.0
                    for column, x in zip(out, ((part << 40) + seq, ids[a + i], len(h) + 1, int(hit.sum()), base, float(sums[i]) + inside, list(zip(rare.tolist(), times.tolist(), strict=True))), strict=True):
                        column.append(x)
                    seq += 1
                rare = [[{"key": k, "times": t} for k, t in r] for r in out.pop()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip([*out, rare], kinds, strict=True)), *(pa.nulls(len(rare), k) for k in (pa.int32(), pa.int32(), pa.binary()))], names=names)
                if gathered > GATHERED:
                    yield written()
                    pairs, gathered = [], 0
        if pairs:
            yield written()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = stage(rows.mapInArrow(score, "row_no long, doc_id long, n_tokens long, n_hot long, hot_sum double, score double, rare array<struct<key:long,times:long>>, group int, pairs int, packed binary"), "suffix-scored")
    model.destroy()
    written_pairs, scored = scored.filter("group IS NOT NULL").select("group", "row_no", "pairs", "packed"), scored.filter("group IS NULL").drop("group", "pairs", "packed")
    # words beyond the hot ones: exact counts by a shuffle join, summed back per row
    rare = scored.select("row_no", F.explode("rare").alias("r")).select("row_no", "r.key", "r.times")
    if (facts["v"] or 0) > hot:
        joined = rare.join(words, "key", "left")
    else:  # every training word is hot: the rest are unseen
        joined = rare.withColumn("n", F.lit(None).cast("long"))
    seen = F.coalesce("n", F.lit(0))
    rest = stage(joined.groupBy("row_no").agg(F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("n_rare"), F.sum(F.col("times") * F.log10(seen + F.lit(ALPHA))).alias("rare_sum")), "suffix-rare")
    # contexts that the tasks do not hold: the deepest one of each position, in groups that hold contexts and pairs
    if left["contexts"]:
        sides = cold.select(F.expr(group_of("context", groups)).alias("group"), "depth", "context", "spread").unionByName(written_pairs, allowMissingColumns=True)
        change = sides.repartition("group").sortWithinPartitions("group", F.col("pairs").isNotNull()).mapInArrow(deeper_changes, "row_no long, change double").groupBy("row_no").agg(F.sum("change").alias("change"))
        scored = scored.join(stage(change, "suffix-deeper"), "row_no", "left").withColumn("score", F.col("score") + F.coalesce("change", F.lit(0.0))).drop("change")
    end_known = 1 if ends else 0

    def last(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([is_held_out(d) for d in batch.column(0).to_pylist()], pa.bool_()), *batch.columns[1:]], names=["doc_id", "held_out", *batch.schema.names[1:]])

    out = scored.drop("rare").join(rest, "row_no", "left").select(
        "doc_id", "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0)) + end_known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0)) - (F.col("n_tokens") - 1) * float(bottom) + end_score).alias("base_score"), "score")
    return out.mapInArrow(last, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_suffix_tree_scores(spark, sf_dir: str) -> DataFrame:
    """Contract query over documents."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
