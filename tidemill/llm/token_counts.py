"""Token counts by a tokenizer compiled to finite-state transducers.

A byte-level BPE vocabulary of the tokenizers library becomes two transducers. The first marks where the split pattern's
matches begin; it looks one character back and two ahead, so whole batches are marked at once. The second reads bytes and
carries a count on each transition: what the text so far counts with the new byte, less what it counted without. The BPE
of a prefix ends in exactly one token, and two tokens stand side by side exactly if no merge across their border comes
before they are complete; so a state is the set of beginnings of tokens that the last bytes may be, each with the token
before it and its count against the whole prefix's. States and transitions are made when a text first needs them; a match's
first byte always leaves from the start state.

Texts are cut into chunks, which advance side by side. A chunk's state map goes from the state at its first byte to the
state behind its last and the count between. Where a match begins near its first byte the map's source is known; elsewhere
it is assumed from the bytes before. A prefix scan composes the maps of a text: those whose source is the target of the map
before are joined, and where it is not, the map is made anew from that target, until every chunk is joined.

Defined results: a null text is empty, with no bytes and no tokens; repeated rows repeat their result; a null doc_id stays
null; an empty table gives an empty result. Strings of added tokens inside a text count as one token each, as is the
library's default. Other columns are ignored. No text is cut short, and the time for a text grows with its length alone.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WHITE, byte_chars
from .common import lean

#: Bytes of a chunk; bytes before it from which its first state is assumed; bytes of texts that advance together.
CHUNK, BEFORE, GROUP = 256, 64, 1 << 20
#: States that are remembered at once, about 200 MB with their transitions.
STATES = 1 << 19
#: The split pattern that is compiled; a vocabulary file must ask for it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

OTHER, LETTER, NUMBER, WHITE_SPACE = range(4)
NEVER = 1 << 60


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point in the split pattern."""
    import regex

    everything = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE_SPACE, f"[{WHITE}]+")):
        for match in regex.finditer(pattern, everything):
            out[match.start() : match.end()] = kind
    return out


def match_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each character whether a match of the split pattern begins there. points: code points of texts one after the
    other; first: places where a text begins."""
    n = len(points)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    edge[n] = True
    before = np.empty(n, np.uint8)  # class of the character before, 9 at a text's beginning
    before[1:] = kind[:-1]
    before[edge[:-1]] = 9
    starts = before != kind
    blank = kind == WHITE_SPACE
    # the last blank of several goes by itself, or with what follows it, unless the text ends there
    last = blank.copy()
    last[:-1] &= ~blank[1:]
    last &= ~edge[1:]
    starts |= last
    # a space is part of the match behind it
    joined = np.zeros(n, bool)
    joined[1:] = (points[:-1] == 32) & last[:-1]
    starts &= ~joined
    # contractions
    at = np.flatnonzero((points == 39) & starts)
    if len(at):
        padded = np.append(points, [0, 0])
        cut = np.append(edge, [True, True])
        one, two = np.where(cut[at + 1], 0, padded[at + 1]), np.where(cut[at + 1] | cut[at + 2], 0, padded[at + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        starts[at[short | long] + 1] = False
        after = np.concatenate([at[short] + 2, at[long] + 3])
        starts[after[after < n]] = True
    return starts


class Vocabulary:
    """Tokens as a tree of bytes, and which tokens may stand side by side."""

    def __init__(self, config: str):
        spec = json.loads(config)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain &= split["type"] == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
        if model["type"] != "BPE" or not plain or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("only plain byte-level BPE vocabularies can be compiled")
        added = sorted((x["content"].encode() for x in spec["added_tokens"] if x["content"]), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        back, ids = {c: b for b, c in enumerate(byte_chars())}, model["vocab"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        #: rank of a merge, and the two halves and rank of what a merge makes
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            self.halves.setdefault(ids[a + b], (ids[a], ids[b], r))
        #: node * 256 + byte -> node; the token that ends in a node; nodes that go on
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.goes_on: list[bool] = [False]
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._beside: dict[tuple[int, int], bool] = {}
        singles = {back[c]: ids[c] for c in back}
        for byte in singles:
            self._add(bytes([byte]), singles[byte])
        for a, b in pairs:
            token = ids[a + b]
            x, y, _ = self.halves[token]
            if self._meet(x, y, final=True):  # else no text ever gives this token
                self._add(bytes(back[c] for c in a + b), token)

    def _add(self, name: bytes, token: int) -> None:
        node = 0
        for byte in name:
            self.goes_on[node] = True
            key = node * 256 + byte
            if key not in self.child:
                self.child[key] = len(self.token)
                self.token.append(-1)
                self.goes_on.append(False)
            node = self.child[key]
        self.token[node] = token

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at a token's left (0) or right (1) edge while it is merged: each with the rank of the merge that ends it."""
        known = self._right if side else self._left
        if token not in known:
            out, at = [(token, NEVER)], token
            while at in self.halves:
                rank = self.halves[at][2]
                at = self.halves[at][side]
                out.append((at, rank))
            known[token] = out[::-1]
        return known[token]

    def _meet(self, a: int, b: int, final: bool = False) -> bool:
        """Whether no merge crosses the border of a and b before both are complete (final), or ever."""
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        rank = self.rank.get
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            if x_ends == y_ends == NEVER:
                return final or (x, y) not in self.rank
            across = rank((x, y), NEVER)
            if across < x_ends and across <= y_ends:  # of equal merges the leftmost is the first
                return False
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def beside(self, a: int, b: int) -> bool:
        """Whether token b may follow token a; anything may come first (-1)."""
        if a < 0:
            return True
        known = self._beside.get((a, b))
        if known is None:
            if len(self._beside) > 500_000:
                self._beside.clear()
            known = self._beside[a, b] = self._meet(a, b)
        return known


class Transitions:
    """State << 8 | byte -> next state << 12 | count + 2048, as an open hash table that whole arrays are sought in at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.held = bits, 0
        self.keys, self.codes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The codes, -1 where there is none."""
        slot = self._slots(keys)
        found = self.keys[slot]
        codes = self.codes[slot]
        rest = np.flatnonzero(found != keys)
        while len(rest):
            empty = found[rest] < 0
            codes[rest[empty]] = -1
            rest = rest[~empty]
            slot[rest] = slot[rest] + 1 & (1 << self.bits) - 1
            found[rest], codes[rest] = self.keys[slot[rest]], self.codes[slot[rest]]
            rest = rest[found[rest] != keys[rest]]
        return codes

    def put(self, keys: np.ndarray, codes: np.ndarray) -> None:
        """Adds keys that are not there. At most a quarter of the slots is used."""
        if (self.held + len(keys)) * 4 > 1 << self.bits:
            old, kept = self.keys[self.keys >= 0], self.codes[self.keys >= 0]
            bits = max(self.bits + 1, int((self.held + len(keys)) * 4).bit_length())
            self.__init__(bits)
            self.put(old, kept)
        self.held += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            set_now = self.keys[slot] == keys  # of several that want one slot the last one has it
            self.codes[slot[set_now]] = codes[set_now]
            keys, codes, slot = keys[~set_now], codes[~set_now], slot[~set_now] + 1 & (1 << self.bits) - 1


class Transducer:
    """States, and their transitions as far as they were needed. A state is a list of packed beginnings: node << 40 |
    token before + 1 << 20 | count + 2048."""

    def __init__(self, vocabulary: Vocabulary):
        self.of = vocabulary
        self.reset()

    def reset(self) -> None:
        start = (2048,)
        self.names, self.number, self.edges = [start], {start: 0}, Transitions()

    def state(self, name: tuple) -> int:
        number = self.number.get(name)
        if number is None:
            number = self.number[name] = len(self.names)
            self.names.append(name)
        return number

    def move(self, state: int, byte: int) -> int:
        """The code of a state's transition by a byte."""
        of, here, total = self.of, [], None
        for begun in self.names[state]:
            child = of.child.get((begun >> 40) << 8 | byte)
            if child is None:
                continue
            if total is None and (token := of.token[child]) >= 0 and of.beside((begun >> 20 & 0xFFFFF) - 1, token):
                last, total = token, (begun & 0xFFFFF) - 2047
            if of.goes_on[child]:
                here.append(child << 40 | begun & 0xFFFFFFFFFF)
        return self.state((*[begun - total for begun in here], last + 1 << 20 | 2048)) << 12 | total + 2048

    def forget(self, arrays: list[np.ndarray]) -> None:
        """Keeps only the states in these arrays, which are numbered anew in place."""
        held = np.unique(np.concatenate(arrays))
        names = [self.names[i] for i in held]
        self.reset()
        new = np.array([self.state(name) for name in names], np.int64)
        for a in arrays:
            a[:] = new[np.searchsorted(held, a)]

    def run(self, data: np.ndarray, fresh: np.ndarray, at: np.ndarray, length: np.ndarray, state: np.ndarray, live: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The states behind the pieces data[at : at + length] entered in these states, and their counts. fresh: bytes that
        leave from the start state. live: arrays of states that the caller still needs."""
        order = np.argsort(-length, kind="stable")
        at, ends, now = at[order], length[order], state[order].astype(np.int64)
        total = np.zeros(len(at), np.int64)
        longer = len(ends) - np.cumsum(np.bincount(ends, minlength=1))
        for step, k in enumerate(longer[longer > 0]):
            place = at[:k] + step
            byte, restart = data[place], fresh[place]
            key = np.where(restart, 0, now[:k]) << 8 | byte
            code = self.edges.find(key)
            if code.min() < 0:
                lacking = code < 0
                new = np.unique(key[lacking])
                if len(self.names) + len(new) > STATES:
                    self.forget([now, *live])
                    key = np.where(restart, 0, now[:k]) << 8 | byte
                    code = self.edges.find(key)
                    lacking = code < 0
                    new = np.unique(key[lacking])
                made = np.array([self.move(x >> 8, x & 255) for x in new.tolist()], np.int32)
                self.edges.put(new, made)
                code[lacking] = made[np.searchsorted(new, key[lacking])]
            now[:k] = code >> 12
            total[:k] += (code & 4095) - 2048
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return now[back], total[back]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        own = np.zeros(len(texts), np.int64)
        parts, of = [], []
        for row, text in enumerate(texts):
            pieces = self.of.added.split(text) if self.of.added else [text]
            own[row] = len(pieces) - 1
            parts += [p for p in pieces if p]
            of += [row] * sum(map(bool, pieces))
        if parts:
            np.add.at(own, of, self._counts(parts))
        return own

    def _counts(self, parts: list[bytes]) -> np.ndarray:
        """Tokens of each of the texts, none empty, without added tokens."""
        whole = b"".join(parts)
        data = np.frombuffer(whole, np.uint8)
        size = np.array([len(p) for p in parts])
        begin = np.cumsum(size) - size
        lead = (data & 0xC0) != 0x80
        points = data if lead.all() else np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        fresh = np.zeros(len(data), bool)
        fresh[lead] = match_starts(points, begin if lead.all() else (np.cumsum(lead) - 1)[begin])
        # chunks, and where the assumed state of each begins
        chunks = -(-size // CHUNK)
        text = np.repeat(np.arange(len(parts)), chunks)
        at = begin[text] + (np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * CHUNK
        length = np.minimum(CHUNK, begin[text] + size[text] - at)
        latest = np.maximum.accumulate(np.where(fresh, np.arange(len(data)), 0))[at]
        known = at - latest <= BEFORE
        warm = np.where(known, latest, at - BEFORE)
        source, _ = self.run(data, fresh, warm, at - warm, np.zeros(len(at), np.int64), [])
        target, count = self.run(data, fresh, at, length, source, [source])
        source = np.where(fresh[at], -1, source)  # a chunk that begins with a match has one target and count from any state
        self._compose(data, fresh, at, length, known, source, target, count)
        return np.bincount(text, count, len(parts)).astype(np.int64)

    def _compose(self, data: np.ndarray, fresh: np.ndarray, at: np.ndarray, length: np.ndarray, known: np.ndarray, source: np.ndarray, target: np.ndarray, count: np.ndarray) -> None:
        """Joins the maps of the chunks in their order. A scan finds for each chunk whether all maps since the last known
        one fit each other; where the first one doesn't, it is made anew from the target before it."""
        place = np.arange(len(at))
        while True:
            before = np.append(0, target[:-1])
            apart = ~known & (source != before)
            if not apart.any():
                return
            first = apart & (np.maximum.accumulate(np.where(known, place, -1)) > np.maximum.accumulate(np.append(-1, np.where(apart, place, -1)[:-1])))
            again = np.flatnonzero(first)
            source[again] = before[again]
            live = [source, target]
            target[again], count[again] = self.run(data, fresh, at[again], length[again], source[again], live)
            known[again] = True


@functools.lru_cache(1)
def transducer(config: str) -> Transducer:
    return Transducer(Vocabulary(config))


def groups(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, in lists of about GROUP bytes; a longer text is a list of its own."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > GROUP:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) for each row of docs."""
    with open(vocabulary_path, encoding="utf-8") as file:
        config = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(config.value)
        for batch in batches:
            texts = (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1).cast(pa.binary()))
            sizes, counts = [], []
            for group in groups(texts):
                sizes += map(len, group)
                counts.append(own.counts(group))
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text")).mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
