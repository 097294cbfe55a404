"""Token counts of whole texts by two compiled finite-state transducers; no token ids are made.

*Cutting.* The scheme's pattern (contractions, words, numbers, other signs, white space) and the strings of added tokens
are one deterministic transducer over classes of characters. A transition is annotated with the pieces that it begins:
at this character, or, where the pattern looks ahead, at the one before. A text's characters are dealt to lanes of
``LANE``; each lane works out its state map (for every state it could be entered in, the state it is left in); the maps
compose, which is associative, in a parallel prefix scan; then every lane knows its entry state and tells its pieces.

*Counting.* Within a piece, a byte pair encoding is what its neighbouring tokens allow: a row of tokens is the encoding
of its bytes exactly if each two neighbours are the encoding of theirs. So each prefix of a piece has one last token,
which depends on the last tokens of the prefixes that end where a longer token may still begin. Those (place in the
trie of tokens, last token before, tokens since) are the state; a transition over a byte is annotated with the change of
the number of tokens, which may be negative. States are made when they are first reached, and a worker keeps at most
``TRANSITIONS`` transitions, after which it starts anew with the same results. A piece's count is the sum along its path;
a worker keeps the sums of up to ``PIECES`` pieces.

Defined results: a null or empty text has no bytes and no tokens; null and repeated ids are rows as others; a text of any
length is gone through in blocks of ``BLOCK`` bytes that hand on the state; an empty table gives no rows; other columns of
the input are not read.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinfold.llm.common import load, slices, small_batches, text_buffer, tidied
from kinfold.llm.token_output import default_tokenizer

#: Characters of a lane, and bytes of text whose lanes are composed at once.
LANE, BLOCK = 64, 1 << 19
#: Transitions between states of counting that a worker keeps.
TRANSITIONS = 1_000_000
#: Pieces, and bytes of a piece at most, whose counts a worker keeps.
PIECES, PIECE_BYTES = 400_000, 64
LIMIT = 1024

# Classes of characters. The pattern's contractions are 's 't 'd 'm 'll 've 're, in small letters.
_CLASSES = ["pad", "begin", "letter", "stdm", "rv", "e", "l", "number", "space", "white", "mark", "other", "added", "in_added"]
C = {name: i for i, name in enumerate(_CLASSES)}
_LETTERS = ("letter", "stdm", "rv", "e", "l")
# States: what a piece that has begun holds; "fresh": the next character begins one.
_STATES = ["fresh", "letters", "numbers", "others", "mark", "mark_rv", "mark_l", "space", "white", "whites_space", "whites", "added"]
S = {name: i for i, name in enumerate(_STATES)}
#: Emitted by a transition: a piece begins here; a piece begins at the character before.
HERE, BEFORE = 1, 2


def _cutter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emitted) by class and state."""
    step = np.zeros((len(_CLASSES), len(_STATES)), np.intp)
    emit = np.zeros((len(_CLASSES), len(_STATES)), np.uint8)
    opens = {**dict.fromkeys(_LETTERS, "letters"), "number": "numbers", "space": "space", "white": "white", "mark": "mark", "other": "others", "added": "added", "in_added": "added"}
    spaced = {**dict.fromkeys(_LETTERS, "letters"), "number": "numbers", "mark": "others", "other": "others"}
    white = {"space": "whites_space", "white": "whites"}
    stays = {
        "letters": dict.fromkeys(_LETTERS, "letters"),
        "numbers": {"number": "numbers"},
        "others": {"mark": "others", "other": "others"},
        "space": {**spaced, **white},  # one space goes with the word after it
        "white": white,
        "whites_space": white,
        "whites": white,
        "mark": {"stdm": "fresh", "rv": "mark_rv", "l": "mark_l", "mark": "others", "other": "others"},
        "mark_rv": {"e": "fresh"},
        "mark_l": {"l": "fresh"},
        "added": {"in_added": "added"},
    }
    for s in _STATES:
        for c in _CLASSES:
            at = C[c], S[s]
            if c == "pad":
                to, out = s, 0
            elif c in stays.get(s, ()):
                to, out = stays[s][c], 0
            elif s in ("mark_rv", "mark_l"):  # no contraction: the mark stood alone, and a word began before
                goes = c in _LETTERS
                to, out = ("letters", BEFORE) if goes else (opens.get(c, "fresh"), BEFORE | (HERE if c != "begin" else 0))
            elif s == "whites_space" and c in spaced:  # the last space goes with the word
                to, out = spaced[c], BEFORE
            elif s == "whites" and c in spaced:  # the last white space is a piece
                to, out = opens[c], BEFORE | HERE
            else:
                to, out = opens.get(c, "fresh"), HERE if c != "begin" else 0
            step[at], emit[at] = S[to], out
    return step, emit


_STEP, _EMIT = _cutter()


def compose(maps: np.ndarray) -> np.ndarray:
    """For each lane, the map of all lanes up to and with it: a prefix scan of the composition of state maps, in as many rounds as the number of lanes has bits."""
    out, d = maps.copy(), 1
    while d < len(out):
        out[d:] = np.take_along_axis(out[d:], out[:-d].copy(), 1)
        d *= 2
    return out


def transduce(classes: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """What the cutter emits at each character of ``classes`` when entered in ``state``, and the state it ends in."""
    n, states = len(classes), len(_STATES)
    lanes = np.full((-(-n // LANE), LANE), C["pad"], np.intp)
    lanes.reshape(-1)[:n] = classes
    step, emit = _STEP.ravel(), _EMIT.ravel()
    rows = np.ascontiguousarray(lanes.T) * states
    maps = np.tile(np.arange(states), (len(lanes), 1))
    for row in rows:
        maps = step[row[:, None] + maps]
    after = compose(maps)[:, state]
    now, out = np.append(state, after[:-1]), np.empty((LANE, len(lanes)), np.uint8)
    for j, row in enumerate(rows):
        at = row + now
        out[j], now = emit[at], step[at]
    return out.T.ravel()[:n], int(after[-1])


class Counter:
    """Counts of a byte-level BPE tokenizer's file, compiled."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        said = json.loads(tok.to_str())
        cutter, model = said["pre_tokenizer"] or {}, said["model"]
        if said["normalizer"] is not None or cutter.get("type") != "ByteLevel" or not cutter.get("use_regex", True) or cutter.get("add_prefix_space") or model.get("type") != "BPE":
            raise ValueError("only byte-level BPE tokenizers that cut by that scheme's pattern are compiled")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("the tokenizer's model has options that are not compiled")
        added = said["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in their neighbourhood are not compiled")
        self.added = [t["content"].encode() for t in added if t["content"]]
        self.cut = tok.pre_tokenizer.pre_tokenize_str
        self.kind = np.zeros(0x110000, np.uint8)  # 0: not yet asked
        self._ask(np.arange(128))
        for name, chars in (("stdm", "stdm"), ("rv", "rv"), ("e", "e"), ("l", "l"), ("space", " "), ("mark", "'")):
            self.kind[[ord(c) for c in chars]] = C[name]
        self._compile(model)

    def _ask(self, points: np.ndarray) -> None:
        """Classes of code points, as the library's own pattern has them."""
        for p in points.tolist():
            together = {name: len(self.cut(before + chr(p))) == 1 for name, before in (("letter", "a"), ("number", "1"), ("other", "!"))}
            self.kind[p] = C[next((name for name, one in together.items() if one), "white")]

    def _compile(self, model: dict) -> None:
        shown = _byte_alphabet()
        ids = {bytes(shown[c] for c in t): i for t, i in model["vocab"].items() if all(c in shown for c in t)}
        if any(bytes([b]) not in ids for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        text = {i: t for t, i in ids.items()}
        self.merges: dict[tuple[int, int], int] = {}  # rank of each pair
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (ids[bytes(shown[c] for c in t)] for t in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = ids[text[a] + text[b]]
            if whole in parts or any(len(text[x]) > 1 and x not in parts for x in (a, b)):
                raise ValueError("a token must have one merge, after those of its parts")
            self.merges[a, b], parts[whole] = rank, (a, b, rank)
        never = len(self.merges)
        self.right: dict[int, list[tuple[int, int]]] = {}  # the tokens at a token's right edge, with the rank of the merge that each goes into
        self.left: dict[int, list[tuple[int, int]]] = {}
        for t in sorted(text, key=lambda t: parts[t][2] if t in parts else -1):
            a, b, rank = parts.get(t, (None, None, never))
            for edge, part in ((self.left, a), (self.right, b)):
                edge[t] = [(t, never)] + ([] if part is None else [(x, rank if x == part else up) for x, up in edge[part]])
        self.child: dict[int, int] = {}  # trie of the tokens: node and byte to node; a node's token, if any
        self.token: list[int] = [-1]
        parents = set()
        for t, i in ids.items():
            if len(t) > 1 and i not in parts:
                continue  # never made by merges
            node = 0
            for b in t:
                parents.add(node)
                node = self.child.setdefault(node << 8 | b, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = i
        self.inner = [n in parents for n in range(len(self.token))]
        self.known: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made = 0
        self.start = self._state(((0, -1, 0),))

    def _state(self, key: tuple) -> dict:
        """The state of ``key``: its transitions by byte, and the key itself under -1."""
        return self.states.setdefault(key, {-1: key})

    def _allowed(self, a: int, b: int) -> bool:
        """Whether the tokens ``a`` and ``b`` are the encoding of their bytes: no tokens at their common edge merge before both have gone into larger ones; of equal pairs the left one merges first."""
        got = self.pairs.get((a, b))
        if got is None:
            never, rank = len(self.merges), self.merges.get
            got = self.pairs[a, b] = not any((r := rank((x, y), never)) < never and r < up_x and r <= up_y for x, up_x in self.right[a] for y, up_y in self.left[b])
        return got

    def _step(self, state: dict, byte: int) -> tuple[dict, int]:
        """Makes the transition of ``state`` over ``byte``: the next state and the change of the count."""
        child, token, ends, grown = self.child, self.token, None, []
        for node, last, since in state[-1]:
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            grown.append((to, last, since))
            t = token[to]
            if ends is None and t >= 0 and (last < 0 or self._allowed(last, t)):
                ends = t, 1 - since
        t, change = ends  # a byte is a token, so there is one
        key = tuple((n, last, since + change) for n, last, since in grown if self.inner[n]) + ((0, t, 0),)
        out = state[byte] = self._state(key), change
        self.made += 1
        return out

    def pieces(self, keys: list[bytes]) -> list[int]:
        """Numbers of tokens of whole pieces."""
        out = []
        for piece in keys:
            if self.made > TRANSITIONS:
                self._reset()
            state, n, since = self.start, 0, 0
            for b in piece:
                to = state.get(b)
                if to is None:
                    to = self._step(state, b)
                    if self.made > 2 * TRANSITIONS:  # within one very long piece
                        key = to[0][-1]
                        self._reset()
                        to = self._state(key), to[1]
                state, change = to
                n += change
            out.append(n)
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        raw, offsets = text_buffer(texts)
        begun = np.zeros(len(raw), bool)
        state, prior, a, n = S["fresh"], 0, 0, len(raw)
        added = self._added(raw, offsets)
        while a < n:
            b = min(n, a + BLOCK)
            while b < n and raw[b] & 0xC0 == 0x80:  # not within a character
                b -= 1
            at, classes = self._classes(raw, a, b, added)
            mark = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)]  # texts that begin here
            where = np.searchsorted(at, mark)
            at, classes = np.insert(at, where, mark), np.insert(classes, where, C["begin"])
            told, state = transduce(classes, state)
            before = np.append(prior, at[:-1])
            begun[before[told & BEFORE > 0]] = begun[at[told & HERE > 0]] = True
            prior, a = int(at[-1]), b
        told, _ = transduce(np.array([C["begin"]]), state)
        if told[0] & BEFORE:
            begun[prior] = True
        start = np.flatnonzero(begun)
        counts = np.zeros(len(start) + 1, np.int64)
        np.cumsum(self._counts(raw, start, {p for p, _ in added}), out=counts[1:])
        ends = counts[np.searchsorted(start, offsets)]
        return np.diff(ends)

    def _added(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Places of added tokens' strings in the texts, the first of those that overlap."""
        data, found = raw.tobytes(), []
        for t in self.added:
            p = data.find(t)
            while p >= 0:
                k = int(np.searchsorted(offsets, p, "right"))
                if p + len(t) <= offsets[k]:
                    found.append((p, p + len(t)))
                p = data.find(t, p + 1)
        out: list[tuple[int, int]] = []
        for p, e in sorted(found, key=lambda x: (x[0], -x[1])):
            if not out or p >= out[-1][1]:
                out.append((p, e))
        return out

    def _classes(self, raw: np.ndarray, a: int, b: int, added: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Places and classes of the characters between two bytes."""
        part = raw[a:b]
        at = np.flatnonzero(part & 0xC0 != 0x80)
        points = part[at].astype(np.int32)
        if len(at) < len(part):
            wide = np.append(part, np.zeros(3, np.uint8)).astype(np.int32)
            big = np.flatnonzero(points >= 0x80)
            b0 = points[big]
            b1, b2, b3 = (wide[at[big] + k] & 0x3F for k in (1, 2, 3))
            two, three, four = (b0 & 0x1F) << 6 | b1, (b0 & 0xF) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3
            points[big] = np.select([b0 < 0xE0, b0 < 0xF0], [two, three], four)
        classes = self.kind[points]
        if not classes.all():
            self._ask(np.unique(points[classes == 0]))
            classes = self.kind[points]
        at = at + a
        for p, e in added:
            if p < b and e > a:
                i, j = np.searchsorted(at, [max(p, a), min(e, b)])
                classes[i:j] = C["in_added"]
                if p >= a:
                    classes[i] = C["added"]
        return at, classes

    def _counts(self, raw: np.ndarray, start: np.ndarray, added: set[int]) -> np.ndarray:
        """Number of tokens of each piece; equal pieces are counted once."""
        if not len(start):
            return np.zeros(0, np.int64)
        offsets = np.append(start, len(raw))
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        keys, known = coded.dictionary.to_pylist(), self.known
        found = list(map(known.get, keys))
        if new := [i for i, n in enumerate(found) if n is None]:
            for i, n in zip(new, self.pieces([keys[i] for i in new])):
                found[i] = n
            if len(known) + len(new) > PIECES:
                known.clear()
            known.update((keys[i], found[i]) for i in new if len(keys[i]) <= PIECE_BYTES)
        counts = np.array(found, np.int64)[coded.indices.to_numpy()]
        if added:
            counts[np.searchsorted(start, sorted(added))] = 1
        return counts


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of the scheme's alphabet stands for: printable ones for themselves, all others in order from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of ``docs`` (doc_id, text). ``tokenizer``: path of a tokenizers file, there on every machine."""
    small_batches(docs.sparkSession)

    @tidied
    def run(batches):
        count = counter(tokenizer).count
        for batch in batches:
            texts = batch.column(1)
            _, offsets = text_buffer(texts)
            n = np.concatenate([np.zeros(0, np.int64), *(count(texts.slice(i, j - i)) for i, j in slices(offsets, 2 * BLOCK))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op12_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents", "doc_id", "text"), default_tokenizer())
