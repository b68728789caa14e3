"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The corpus's most frequent words, with the token ids that the merges give them, are compiled
into a minimal acyclic automaton whose suffixes are shared. Each arc carries the number of words
that sort before it in its state, so the sum along a word's path is the word's place in sorted
order, and ids and decoded pieces are stored by place. The automaton is a flat file that
workers memory-map. Words that are not in it are merged exactly.
"""

from __future__ import annotations

import contextlib
import hashlib
import heapq
import json
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pretokens import byte_letters, split
from .store import materialize
from .textkit import slices

LEXICON_WORDS = 1 << 15
#: These two set what a task holds besides its batch.
MEMO_WORDS = 200_000
SLICE_BYTES = 1 << 19
NO_RANK = np.int64(1) << 40
#: Bytes from which a word is merged by itself.
LONG_WORD = 1 << 10


class Merges:
    """The exact merges of a word-end BPE file of the tokenizers library."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = dict(spec["model"]["vocab"])
        self.end = spec["model"]["end_of_word_suffix"]
        self.letters = byte_letters()
        self.bytes_of = {letter: byte for byte, letter in self.letters.items()}
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.inner = np.array([vocab[self.letters[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[self.letters[b] + self.end] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def ids(self, found: list[bytes]) -> list[list[int]]:
        """ids of each word: long words one by one; of the others, in every round each merges all places of its lowest-ranked pair."""
        if any(len(w) > LONG_WORD for w in found):
            short = iter(self.ids([w for w in found if len(w) <= LONG_WORD]))
            return [self.long_ids(w) if len(w) > LONG_WORD else next(short) for w in found]
        out: list = [None] * len(found)
        sizes = np.array([len(w) for w in found], np.int64)
        raw = np.frombuffer(b"".join(found), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(found)), sizes)
        while len(symbols):
            rank = np.full(len(symbols), NO_RANK)
            rank[:-1] = np.where(word[1:] == word[:-1], self.rank(symbols[:-1], symbols[1:]), NO_RANK)
            begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            spans = np.diff(np.append(begins, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, begins), spans)
            done = best == NO_RANK
            if done.any():
                for a, n in zip(begins[done[begins]].tolist(), spans[done[begins]].tolist(), strict=True):
                    out[word[a]] = symbols[a : a + n].tolist()
                symbols, word, rank, best = symbols[~done], word[~done], rank[~done], best[~done]
                if not len(symbols):
                    break
            hit = rank == best
            # of places in a row (aaa), every second one merges
            run_start = hit & ~np.concatenate([[False], hit[:-1]])
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run_start, np.arange(len(hit)), 0))
            hit &= place % 2 == 0
            symbols[hit] = self.made[rank[hit]]
            keep = ~np.concatenate([[False], hit[:-1]])
            symbols, word = symbols[keep], word[keep]
        return out

    def long_ids(self, word: bytes) -> list[int]:
        """ids of one word, in time that grows little faster than its length: pairs wait in a heap by rank and place, symbols are a linked list."""
        raw = np.frombuffer(word, np.uint8)
        symbols = self.inner[raw]
        symbols[-1] = self.final[raw[-1]]
        rank = self.rank(symbols[:-1], symbols[1:])
        places = np.flatnonzero(rank < NO_RANK)
        waiting = list(zip(rank[places].tolist(), places.tolist(), symbols[places].tolist(), symbols[places + 1].tolist(), strict=True))
        heapq.heapify(waiting)
        at, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[int, int] = {}

        def wait(left: int, right: int) -> None:
            key = at[left] << 20 | at[right]
            if key not in known:
                known[key] = int(self.rank(np.array([at[left]]), np.array([at[right]]))[0])
            if known[key] < NO_RANK:
                heapq.heappush(waiting, (known[key], left, at[left], at[right]))

        while waiting:
            r, k, left, right = heapq.heappop(waiting)
            following = after[k]
            if at[k] != left or following >= n or at[following] != right:
                continue  # one of the two has been merged meanwhile
            at[k], at[following] = int(self.made[r]), -1
            after[k] = after[following]
            if after[k] < n:
                before[after[k]] = k
                wait(k, after[k])
            if before[k] >= 0:
                wait(before[k], k)
        return [x for x in at if x >= 0]

    def slow_words(self, text: str) -> list[bytes | int]:
        """Words of any text by the library's own normaliser and splitter; special tokens as their ids."""
        out: list[bytes | int] = []
        for piece in regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text):
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                shown = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(piece))
                out += [bytes(self.bytes_of[c] for c in word) for word, _ in shown]
        return out

    def shown(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids)


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The automaton of distinct non-empty words (sorted here), as one block of arrays.

    Words are added in order; when a branch can no longer change, each of its states is replaced by
    an equal one seen before, so the automaton stays minimal.
    """
    entries = sorted(entries)
    states: list[tuple[bool, dict[int, int]]] = [(False, {})]
    register: dict[tuple, int] = {}
    path, last = [0], b""

    def settle(depth: int) -> None:
        for k in range(len(path) - 1, depth, -1):
            final, arcs = states[path[k]]
            same = register.setdefault((final, *sorted(arcs.items())), path[k])
            states[path[k - 1]][1][last[k - 1]] = same
        del path[depth + 1 :]

    for word, _ in entries:
        common = len(os.path.commonprefix([word, last]))
        settle(common)
        for letter in word[common:]:
            states.append((False, {}))
            states[path[-1]][1][letter] = len(states) - 1
            path.append(len(states) - 1)
        states[path[-1]] = (True, states[path[-1]][1])
        last = word
    settle(0)

    count: dict[int, int] = {}
    order: list[int] = []
    todo = [0]
    while todo:  # children before parents
        s = todo[-1]
        missing = [t for t in states[s][1].values() if t not in count]
        if missing:
            todo += missing
        else:
            todo.pop()
            if s not in count:
                count[s] = states[s][0] + sum(count[t] for t in states[s][1].values())
                order.append(s)
    number = {s: k for k, s in enumerate(reversed(order))}  # the root is 0
    keys, targets, skips = [], [], []
    for s in reversed(order):
        before = int(states[s][0])
        for letter, t in sorted(states[s][1].items()):
            keys.append(number[s] << 8 | letter)
            targets.append(number[t])
            skips.append(before)
            before += count[t]
    finals = [int(states[s][0]) for s in reversed(order)]
    firsts = np.concatenate([[0], np.cumsum([len(ids) for _, ids in entries])])
    arrays = [np.array(x, np.int32) for x in (keys, targets, skips, finals, firsts, [i for _, ids in entries for i in ids])]
    return np.array([len(a) for a in arrays], np.int32).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A memory-mapped automaton; ``find`` looks up many words at once."""

    def __init__(self, path: str):
        block = np.memmap(path, np.int32, "r")
        ends = 6 + np.concatenate([[0], np.cumsum(block[:6])])
        self.keys, self.targets, self.skips, self.finals, self.firsts, self.ids = (block[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))

    def find(self, found: list[bytes]) -> np.ndarray:
        """Each word's place in the lexicon, or -1: one step of all words for each byte position."""
        out = np.full(len(found), -1)
        if not len(self.keys) or not found:
            return out
        sizes = np.array([len(w) for w in found])
        raw = np.frombuffer(b"".join(found), np.uint8).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        state, place = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        alive = np.arange(len(found))
        for k in range(int(sizes.max())):
            alive = alive[sizes[alive] > k]
            if not len(alive):
                break
            key = state[alive] << 8 | raw[first[alive] + k]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[arc] == key
            alive, arc = alive[there], arc[there]
            state[alive] = self.targets[arc]
            place[alive] += self.skips[arc]
            ended = alive[(sizes[alive] == k + 1)]
            ended = ended[self.finals[state[ended]] == 1]
            out[ended] = place[ended]
        return out

    def ids_at(self, place: int) -> list[int]:
        return self.ids[self.firsts[place] : self.firsts[place + 1]].tolist()


_merges: dict[str, Merges] = {}
_lexicons: dict[str, Lexicon] = {}


def merges(path: str) -> Merges:
    if path not in _merges:
        _merges[path] = Merges(path)
    return _merges[path]


def mapped(block: bytes) -> Lexicon:
    """The block as a memory-mapped file of this machine, shared by its workers; a file that is not the block is written anew."""
    name = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(block).hexdigest()[:24]}.bin")
    if name not in _lexicons:
        if not _holds(name, block):
            with tempfile.NamedTemporaryFile(dir=os.path.dirname(name), delete=False) as f:
                f.write(block)
            with contextlib.suppress(OSError):
                os.replace(f.name, name)
        _lexicons[name] = Lexicon(name)
    return _lexicons[name]


def _holds(name: str, block: bytes) -> bool:
    try:
        with open(name, "rb") as f:
            return f.read(len(block) + 1) == block
    except OSError:
        return False


def word_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """word (binary), n: how often each BPE word occurs in the whole texts of ``docs``."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch.column("text"), SLICE_BYTES):
                found = split(part, clip=True)
                safe = np.repeat(~found.unsafe, np.diff(found.first))
                for word, n in zip(found.distinct, np.bincount(found.codes[safe], minlength=len(found.distinct)).tolist(), strict=True):
                    if n:
                        counts[word] = counts.get(word, 0) + n
                for i in np.flatnonzero(found.unsafe):
                    for word in merges(tokenizer_path).slow_words(part.text(i).decode()):
                        if isinstance(word, bytes):
                            counts[word] = counts.get(word, 0) + 1
                if len(counts) > MEMO_WORDS:
                    yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})
                    counts = {}
        if counts:
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    return docs.select("text").mapInArrow(task, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer_path: str, size: int = LEXICON_WORDS, longest: int = 64) -> bytes:
    """The most frequent words of at most ``longest`` bytes, ``size`` at most, compiled; some MB at any scale.

    The least count that leaves no more than ``size`` words comes from the number of words with each
    count, so that only the words of the lexicon reach the driver.
    """
    counts = materialize(word_counts(docs, tokenizer_path).filter(F.octet_length("word") <= longest))
    by_count = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    levels = counts.groupBy("n").agg(F.count("*").alias("words")).withColumn("upto", F.sum("words").over(by_count))  # one row a count
    least = levels.filter(F.col("upto") <= size).agg(F.min("n")).first()[0]
    found = [bytes(r.word) for r in counts.filter(F.col("n") >= least).select("word").collect()] if least else []
    return compile_lexicon(list(zip(found, merges(tokenizer_path).ids(found), strict=True)) if found else [])


def encode_decode(docs: DataFrame, tokenizer_path: str, size: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of (doc_id, text), and with ``with_ids`` ids and decoded.

    ids are those of Tokenizer.encode(text, add_special_tokens=False), spellings of special tokens
    included; decoded is Tokenizer.decode(ids, skip_special_tokens=False), which for a file without
    a decoder joins token strings by one space. ids_sha256 digests the decimal ids, joined by one
    space. A text and a word may have any length. Null and empty texts have no tokens and decode to ''. Equal rows give equal rows; a
    null doc_id stays null; other columns are ignored; no rows give no rows.
    """
    block = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, tokenizer_path, size))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(mapped(block.value), merges(tokenizer_path))
        for batch in batches:
            for part in slices(batch.column("text"), SLICE_BYTES):
                found = split(part, clip=True)
                known = words.known(found.distinct)
                out: list[list] = [[] for _ in range(3 + 2 * with_ids)]
                for i in range(part.last - part.first):
                    if found.unsafe[i]:
                        mine = words.slow(part.text(i).decode())
                    else:
                        mine = [known[c] for c in found.codes[found.first[i] : found.first[i + 1]].tolist()]
                    ids, decoded = " ".join([m[1] for m in mine]), " ".join([m[2] for m in mine])
                    digests = [sum(m[0] for m in mine), *(hashlib.sha256(x.encode()).hexdigest() for x in (ids, decoded))]
                    for column, value in zip(out, [*digests, [int(x) for x in ids.split()], decoded], strict=False):
                        column.append(value)
                ids = batch.column("doc_id").slice(part.first, part.last - part.first)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(out, kinds, strict=False))], names[: 1 + len(out)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, schema)


class _Words:
    """(number of ids, ids as text, decoded text) of words: a bounded memo, the lexicon, then the merges."""

    def __init__(self, lexicon: Lexicon, rules: Merges):
        self.lexicon, self.rules, self.memo = lexicon, rules, {}

    def known(self, found: list[bytes]) -> list[tuple[int, str, str]]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = [w for w in found if w not in self.memo]
        places = self.lexicon.find(new)
        unseen = [w for w, p in zip(new, places.tolist(), strict=True) if p < 0]
        merged = dict(zip(unseen, self.rules.ids(unseen), strict=True)) if unseen else {}
        for word, place in zip(new, places.tolist(), strict=True):
            ids = self.lexicon.ids_at(place) if place >= 0 else merged[word]
            self.memo[word] = (len(ids), " ".join(map(str, ids)), self.rules.shown(ids))
        return [self.memo[w] for w in found]

    def slow(self, text: str) -> list[tuple[int, str, str]]:
        found = self.rules.slow_words(text)
        known = iter(self.known([w for w in found if isinstance(w, bytes)]))
        return [(1, str(w), self.rules.token[w]) if isinstance(w, int) else next(known) for w in found]
