"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Splitting: the published split pattern of such vocabularies is compiled by hand to
a deterministic transducer over 12 character classes with 13 states; each transition
is annotated with the pieces that it starts, at the character it reads or at the one
before. A batch of texts, with a reset symbol after each, is cut into chunks that run
in lockstep. A chunk's state map (exit state for each entry state) is found first,
the maps are composed by a parallel prefix scan, and with its entry state known each
chunk emits its annotations. Long texts are many chunks, so none runs alone.

Counting: within a piece the state is the last token of the prefix read so far. By
the uniqueness of BPE, the encoding of a prefix ends in the one token t for which
what precedes it ends in a token that may stand before t; taking t emits one more
token. Two tokens may stand side by side if no merge crosses their border while the
merges inside them run, which is read off their merge trees. These states are too many
to tabulate, so transitions are made as they occur. All distinct pieces of a batch
take their transitions in lockstep; counts of pieces are kept per worker. Pieces of
more than LONG bytes are cut into chunks, whose maps from entry state to exit state
and emitted tokens are made in lockstep too and composed by a parallel prefix scan.

The library's handling of special strings is followed: they stand for one token each.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are
counted each; an empty table gives no rows. Vocabularies other than byte-level BPE
with this split pattern raise ValueError.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small_batches
from ._shingles import _BASE, _INVERSE, U, _powers, mix
from .packing import _bytes_of, tokenizer_path

CHUNK, BATCH_CHARS, KEPT, LONG = 512, 1_000_000, 400_000, 256
#: Bytes of all pieces whose possible tokens are found at once.
STEPS = 1 << 17
# character classes: other letters, digits, others, apostrophe, space, other white space, and letters of contractions
LETTER, DIGIT, OTHER, APOS, SPACE, WHITE, STMD, R, V, ELL, E, RESET = range(12)
# states: nothing read; in a run; white space runs of one and of more, ending in a space or not; contractions begun and done
START, IN_L, IN_N, IN_O, S1, W1, S2, W2, Q, QR, QV, QL, DONE = range(13)
HERE, BACK = 1, 2
#: Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": DIGIT}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = WHITE
    for chars, c in ((" ", SPACE), ("'", APOS), ("stmd", STMD), ("r", R), ("v", V), ("l", ELL), ("e", E)):
        out[[ord(x) for x in chars]] = c
    return out


@lru_cache(maxsize=1)
def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, annotation) by state and class."""
    letters = (LETTER, STMD, R, V, ELL, E)
    step, note = np.zeros((13, 12), np.uint8), np.zeros((13, 12), np.uint8)
    for s in range(13):
        for c in range(11):
            white = s in (S1, W1, S2, W2)
            back = BACK if s in (S2, W2) or s in (QR, QV, QL) else 0  # what was read last starts a piece after all
            if c in (SPACE, WHITE):
                to = ((S2 if c == SPACE else W2) if white else (S1 if c == SPACE else W1), (0 if white else HERE) | (back if s in (QR, QV, QL) else 0))
            elif s == Q and c == STMD:
                to = (DONE, 0)
            elif s == Q and c in (R, V, ELL):
                to = ({R: QR, V: QV, ELL: QL}[c], 0)
            elif (s in (QR, QV) and c == E) or (s == QL and c == ELL):
                to = (DONE, 0)
            else:
                run = IN_L if c in letters else IN_N if c == DIGIT else IN_O
                had = {QR: IN_L, QV: IN_L, QL: IN_L, Q: IN_O}.get(s, s)
                starts = not (had == run or s in (S1, S2))
                to = (Q if c == APOS and starts else run, (HERE if starts else 0) | back)
            step[s, c], note[s, c] = to
        step[s, RESET], note[s, RESET] = START, HERE | (BACK if s in (QR, QV, QL) else 0)
    return step, note


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Where pieces start, and at each reset, in a stream of classes."""
    step, note = _splitter()
    n = -(-len(classes) // CHUNK)
    grid = np.full(n * CHUNK, RESET, np.uint8)
    grid[: len(classes)] = classes
    grid = np.ascontiguousarray(grid.reshape(n, CHUNK).T)
    maps = np.repeat(np.arange(13, dtype=np.uint8)[:, None], n, 1)
    tail = maps.copy()
    for row in grid[-16:]:  # most chunks end in the same state wherever they begin, which their last symbols show
        tail = step[tail, row]
    open_ = np.flatnonzero((tail != tail[0]).any(0))
    maps[:] = tail
    if len(open_):
        some = np.repeat(np.arange(13, dtype=np.uint8)[:, None], len(open_), 1)
        for row in grid[:, open_]:
            some = step[some, row]
        maps[:, open_] = some
    hop = 1
    while hop < n:  # inclusive scan: after each round a map covers twice as many chunks
        maps[:, hop:] = np.take_along_axis(maps[:, hop:], maps[:, :-hop], 0)
        hop *= 2
    state = np.concatenate(([START], maps[START, :-1])).astype(np.uint8)
    notes = np.empty_like(grid)
    for t, row in enumerate(grid):
        notes[t] = note[state, row]
        state = step[state, row]
    notes = notes.T.reshape(-1)[: len(classes)]
    out = (notes & HERE).astype(bool)
    out[:-1] |= (notes[1:] & BACK).astype(bool)
    return out


class _Table:
    """Integers from 64-bit keys, looked up by the array; -1 where there is none."""

    def __init__(self, found: dict[int, int]):
        self.bits = max(10, (4 * len(found)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, 0xFFFFFFFFFFFFFFFF, U), np.full(size, -1, np.int32)
        keys, values = np.fromiter(found, U, len(found)), np.fromiter(found.values(), np.int32, len(found))
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == U(0xFFFFFFFFFFFFFFFF)
            spot, first = np.unique(at[left][free], return_index=True)
            won = left[free][first]
            self.keys[spot], self.values[spot] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) % size

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there != U(0xFFFFFFFFFFFFFFFF)))
        while len(left):
            at[left] = (at[left] + 1) % len(self.keys)
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there != U(0xFFFFFFFFFFFFFFFF))]
        return out


class Transducer:
    """Counts tokens for the vocabulary file at path."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        before = spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE vocabularies are compiled")
        self.special = [a["content"] for a in spec.get("added_tokens") or [] if a.get("special")]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max(vocab.values()) + 1
        # rank: when a token is made; left and right: of what. Bytes are there from the start.
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        merges: dict[int, int] = {}
        for k, (a, b) in enumerate(pairs):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            self.rank[t], self.left[t], self.right[t] = k, x, y
            merges[x << 32 | y] = k
        self.merges = _Table(merges)
        made = {t for t in range(size) if self.rank[t] >= 0}
        # tokens backwards in a tree; only those that BPE itself makes of their bytes
        tree: dict[int, int] = {}
        ends = [-1]
        self.longest = 1
        for word, t in vocab.items():
            if word in self.special or (t not in made and len(word) != 1):
                continue
            raw, node = _bytes_of(word), 0
            for byte in reversed(raw):
                key = node << 8 | byte
                node = tree.get(key) or tree.setdefault(key, len(tree) + 1)
                if node == len(ends):
                    ends.append(-1)
            ends[node] = t
            self.longest = max(self.longest, len(raw))
        self.tree, self.ends = _Table(tree), np.array(ends, np.int64)
        self._drop_unreachable()
        self.kept: dict[int, int] = {}
        self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def _drop_unreachable(self) -> None:
        """A token whose own two parts may stand side by side is never made of them."""
        t = self.ends[self.ends >= 0]
        t = t[self.rank[t] >= 0]
        broken = t[self._blocked(self.left[t], self.right[t], self.rank[t])]
        self.ends[np.isin(self.ends, broken)] = -1

    def _blocked(self, a: np.ndarray, b: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether, for tokens made of a and b by the merge own, another merge crosses the border earlier."""
        return ~self._side_by_side(a, b, own)

    def _side_by_side(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of a and b (up to the merge ``before``).

        Going back in time from the finished tokens, the later made of the two at the
        border is undone: before its making its outer part stood there. A crossing merge
        counts if its rank comes before the making of what was undone last; of equal
        ranks the leftmost merge goes first, so there it counts only if b's part was undone.
        """
        r, l = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 40, np.int64) if before is None else before.copy()
        good, live, equal = np.ones(len(a), bool), np.arange(len(a)), np.zeros(len(a), np.int64)
        while len(live):
            x, y = r[live], l[live]
            m = self.merges.get(x.astype(U) << U(32) | y.astype(U))
            bad = (m >= 0) & (m < limit[live] + equal[live])
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo_left = rx > ry
            limit[live], equal[live] = np.maximum(rx, ry), ~undo_left
            r[live[undo_left]] = self.right[x[undo_left]]
            l[live[~undo_left]] = self.left[y[~undo_left]]
        return good

    def count_pieces(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of the pieces raw[start : start + size], none of them empty."""
        out = np.zeros(len(start), np.int64)
        order = np.argsort(-size, kind="stable")
        long = int((size > LONG).sum())
        if long:
            out[order[:long]] = self._in_chunks(raw, start[order[:long]], size[order[:long]])
        for lo in range(long, len(order), 8192):
            some = order[lo : lo + 8192]
            out[some] = self._lockstep(raw, start[some], size[some])
        return out

    def _in_chunks(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Long pieces. A state is the last tokens of the prefixes that a coming token may reach back to, with their counts.

        A chunk's map says for each entry state which exit state and how many tokens follow. Chunks that read the same bytes share
        one map. All chunks run in lockstep first, each from a guess of its entry state that a run-up over the bytes before it gives;
        chunks of the same bytes begin theirs at different places, so that periodic pieces meet their phases. Then exit states that the
        chunks coming next don't know yet run, all in lockstep again, until every map knows what its predecessors lead to. A
        parallel prefix scan over all pieces composes the maps.
        """
        span, chunks = max(LONG, self.longest), -(-size // max(LONG, self.longest))
        piece, first = np.repeat(np.arange(len(start)), chunks), np.cumsum(chunks) - chunks
        at = (np.arange(len(piece)) - first[piece]) * span  # where in its piece a chunk begins
        end, where = np.minimum(at + span, size[piece]), start[piece]
        groups: dict[tuple[bool, bytes], int] = {}
        heads = zip(at == 0, where + np.maximum(0, at - self.longest), where + end)
        group = np.array([groups.setdefault((bool(head), raw[lo:hi].tobytes()), len(groups)) for head, lo, hi in heads])
        by_group = np.argsort(group, kind="stable")
        turn = np.empty(len(group), np.int64)  # how many chunks of the same bytes came before
        turn[by_group] = np.arange(len(group)) - np.searchsorted(group[by_group], group[by_group])
        one_of = by_group[np.searchsorted(group[by_group], np.arange(len(groups)))]
        inner = np.flatnonzero(np.append(at[1:] > 0, False))
        following: list[set[int]] = [set() for _ in groups]
        for g, h in {*zip(group[inner].tolist(), group[inner + 1].tolist())}:
            following[g].add(h)
        ids: dict[bytes, int] = {b"": 0}
        table: list[dict[int, tuple[int, int]]] = [{} for _ in groups]  # by group: entry state to exit state and emitted tokens

        guessed = np.flatnonzero(turn < np.where(at == 0, 1, self.longest))
        begin = np.where(at == 0, 0, np.maximum(0, at - 2 * self.longest - turn))
        guessed = guessed[np.argsort((begin - end)[guessed], kind="stable")]
        due = []
        for lo in range(0, len(guessed), 4096):
            some = guessed[lo : lo + 4096]
            for k, (entry, leave, emitted) in zip(some, self._lockstep(raw, (where + begin)[some], (end - begin)[some], (at - begin)[some])):
                entry, leave = ids.setdefault(entry if at[k] else b"", len(ids)), ids.setdefault(leave, len(ids))
                table[group[k]][entry] = leave, emitted
                due.append((group[k], leave))
        while due:
            unknown = {(h, state) for g, state in due for h in following[g] if state not in table[h]}
            due, names = [], list(ids)
            unknown = sorted(unknown, key=lambda x: at[one_of[x[0]]] - end[one_of[x[0]]])
            for lo in range(0, len(unknown), 4096):
                some = unknown[lo : lo + 4096]
                ks = one_of[[h for h, _ in some]]
                resume = np.array([np.frombuffer(names[state], "<i4").reshape(2, -1) for _, state in some]).astype(np.int64)
                for (h, state), (_, leave, emitted) in zip(some, self._lockstep(raw, (where + at)[ks], (end - at)[ks], resume=resume)):
                    leave = ids.setdefault(leave, len(ids))
                    table[h][state] = leave, emitted
                    due.append((h, leave))
        return self._scan(group, at, first, table)

    @staticmethod
    def _scan(group: np.ndarray, at: np.ndarray, first: np.ndarray, table: list[dict[int, tuple[int, int]]]) -> np.ndarray:
        """Tokens of each piece. A node is a chunk with one of its entry states; in each step a node's map takes in the equally long one after it."""
        width = np.array([len(t) for t in table])[group]
        offset = np.cumsum(width) - width
        done = int(width.sum())
        place = [{state: i for i, state in enumerate(t)} for t in table]
        total = np.concatenate([*(np.array([n for _, n in table[g].values()], np.int64) for g in group), [0]])
        after, known = np.full(done + 1, done), {}
        for k in np.flatnonzero(np.append(at[1:] > 0, False)):
            pair = group[k], group[k + 1]
            if pair not in known:
                known[pair] = np.array([place[pair[1]][leave] for leave, _ in table[pair[0]].values()])
            after[offset[k] : offset[k] + width[k]] = offset[k + 1] + known[pair]
        while (after != done).any():
            total, after = total + total[after], after[after]
        return total[offset[first]]

    def _state(self, last: np.ndarray, count: np.ndarray) -> bytes:
        """last, count: of the last prefixes, latest first."""
        return last.astype("<i4").tobytes() + (count - count[0]).astype("<i4").tobytes()

    def _endings(self, raw: np.ndarray, start: np.ndarray, active: np.ndarray, low: int, high: int, alone: bool):
        """The tokens that end after low to high - 1 bytes of each piece: where those of each step begin; lane, token and length, short ones first.

        alone: no token begins before its piece.
        """
        steps = np.arange(low, high)
        lanes = active[steps - 1]
        step = np.repeat(steps, lanes)
        lane = np.arange(len(step)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        node, found = np.zeros(len(step), np.int64), []
        for back in range(1, self.longest + 1):
            if alone:
                inside = step >= back
                step, lane, node = step[inside], lane[inside], node[inside]
            node = self.tree.get(node.astype(U) << U(8) | raw[start[lane] + step - back].astype(U)).astype(np.int64)
            alive = node >= 0
            step, lane, node = step[alive], lane[alive], node[alive]
            if not len(lane):
                break
            token = self.ends[node]
            whole = token >= 0
            found.append((step[whole], lane[whole], token[whole].astype(np.int64), np.full(int(whole.sum()), back)))
        step, *rest = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(step, kind="stable")
        return np.searchsorted(step[order], np.append(steps, high)), [x[order] for x in rest]

    def _lockstep(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, entry: np.ndarray | None = None, resume: np.ndarray | None = None):
        """Pieces in order of falling size. State after i bytes: last token and count, for the last few i.

        Returns the counts; with entry, for each piece the state after entry bytes, the state at its end and the tokens emitted in between.
        With resume, the same for what goes on from a given state: by piece, last tokens and counts of the prefixes before it, latest first.
        """
        n, longest, ring = len(start), int(size[0]), self.longest + 1
        last, count = np.full((ring, n), -1, np.int64), np.zeros((ring, n), np.int64)
        out = np.zeros(n, np.int64)
        active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # pieces of at least i bytes
        entered, states = {}, [None] * n
        if resume is not None:
            before_it = -np.arange(self.longest) % ring
            last[before_it], count[before_it] = resume[:, 0].T, resume[:, 1].T

        def state(i: int, k: int):
            rows = (i - np.arange(self.longest)) % ring
            last_, count_ = last[rows, k].copy(), count[rows, k].copy()
            if resume is None:
                last_[i + 1 :], count_[i + 1 :] = -1, count_[0]
            return self._state(last_, count_), int(count[i % ring, k])

        window = max(1, STEPS // n)
        for i in range(1, longest + 1):
            m = active[i - 1]
            if (i - 1) % window == 0:
                low, bounds, found = i, *self._endings(raw, start, active, i, min(i + window, longest + 1), resume is None)
            lane, token, back = (x[bounds[i - low] : bounds[i - low + 1]] for x in found)
            before = last[(i - back) % ring, lane]
            fits = (before < 0) & (back == i) if resume is None else np.zeros(len(lane), bool)
            other = np.flatnonzero(before >= 0)
            fits[other] = self._side_by_side(before[other], token[other])
            lane, token, back = lane[fits], token[fits], back[fits]
            last[i % ring, lane], count[i % ring, lane] = token, count[(i - back) % ring, lane] + 1
            ended = size[:m] == i
            out[:m][ended] = count[i % ring, :m][ended]
            if entry is not None or resume is not None:
                for k in np.flatnonzero(entry[:m] == i) if entry is not None else ():
                    entered[k] = state(i, k)
                for k in np.flatnonzero(ended):
                    (before_, had), (after, has) = entered.get(k, (b"", 0)), state(i, k)
                    states[k] = before_, after, has - had
        return out if entry is None and resume is None else states

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        held, owners, chars = [], [], 0
        for k, text in enumerate(texts):
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            out[k] += len(parts) - 1
            for part in parts:
                held.append(part)
                owners.append(k)
                chars += len(part) + 1
            if chars >= BATCH_CHARS:
                self._add(held, owners, out)
                held, owners, chars = [], [], 0
        if held:
            self._add(held, owners, out)
        return out

    def _add(self, parts: list[str], owners: list[int], out: np.ndarray) -> None:
        joined = "\x00".join(parts) + "\x00"
        data = joined.encode("utf-8", "replace")
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
        resets = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes = _classes()[points]
        classes[resets] = RESET
        bounds = np.flatnonzero(piece_starts(classes))
        raw = np.frombuffer(data, np.uint8)
        byte_at = np.flatnonzero((raw & 0xC0) != 0x80)
        begin = byte_at[bounds]
        end = np.append(begin[1:], len(raw))
        real = classes[bounds] != RESET
        owner = np.asarray(owners)[np.searchsorted(resets, bounds[real])]
        begin, end = begin[real], end[real]
        if not len(begin):
            return
        sums = np.concatenate((np.zeros(1, U), np.cumsum((raw.astype(U) + U(1)) * _powers(_BASE, len(raw)))))
        keys = mix((sums[end] - sums[begin]) * _powers(_INVERSE, len(raw))[begin])
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.fromiter((self.kept.get(k, -1) for k in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(counts < 0)
        if len(new):
            counts[new] = self.count_pieces(raw, begin[first[new]], end[first[new]] - begin[first[new]])
            if len(self.kept) + len(new) > KEPT:
                self.kept.clear()
            self.kept.update(zip(distinct[new].tolist(), counts[new].tolist()))
        out += np.bincount(owner, counts[which], len(out)).astype(np.int64)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens."""
    small_batches(docs.sparkSession)

    def run(batches):
        machine = transducer(tokenizer)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "n_bytes": batch["n_bytes"], "n_tokens": machine.count(batch["text"].tolist())})

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInPandas(run, "id long, n_bytes long, n_tokens long")


#: Documents of more tokens are over the limit.
LIMIT = 512


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = token_counts(docs, tokenizer or tokenizer_path())
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
