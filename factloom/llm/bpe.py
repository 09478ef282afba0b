"""BPE encoding and decoding by a tokenization automaton (operator 10).

The automaton reads tokens. It starts as one state with an arc to itself for every byte. Merges are compiled
in order of rank, each as a *merge gadget*: for ``(u, v) -> w`` a copy of the state behind ``u`` without the
arc ``v`` becomes the state behind ``u``, and every state that has the arc ``u`` gets the arc ``w``, which
leads where ``v`` led. Afterwards a token sequence is a path exactly if it is what the merges make of its text,
and each text has exactly one such path, so the automaton is a deterministic encoder.

Tables. All arcs of one label lead to one state. Gadgets only ever copy a state less one arc, so a state is its
ancestors' lost arcs. An arc lost in the gadget of rank ``k`` takes with it the arcs that grew out of it later: its
descendants by left parts from rank ``k`` on. With tokens numbered so that these stand next to it (``place``), every state
is a sorted list of lost intervals, and all lists lie in one array: an arc is there if an even number of the state's
interval ends lie at or below the token's place. A second table, a suffix trie with failure arcs and one row of 256
bytes per inner node, gives for every byte read the longest token that ends there, then the next shorter ones. Words
are encoded by these tables alone, all new words of a batch at once: at each byte the one token is taken that ends there
and has an arc from the state at its start.

Words come from the vocabulary's own pre-split pattern, read from its file, and are kept in a bounded memo. Decoding
emits the arc labels (bytes) of the ids.

Defined results: null text is the empty text; an empty text has no tokens (digests of nothing); repeated rows and
equal or missing ids are encoded each on their own; special strings inside texts become their special id, as the
library does by default; other columns are ignored; an empty table gives an empty result; bytes that are not UTF-8 after
decoding become U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common as C

#: What byte-level vocabularies that name no pattern split with, and what begins a word of one letter class after a blank.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and bytes of words that a worker remembers; words up to this many bytes are encoded side by side.
MEMO_WORDS, MEMO_BYTES, SIDE_BY_SIDE = 250_000, 24 << 20, 200
#: Bytes of text that are split together.
SLICE = 3 << 20
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_NEVER = 1 << 60
_SHIFT = 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_pattern(spec: dict) -> str:
    """The pre-split pattern of a byte-level vocabulary file; other vocabularies are refused."""
    if spec.get("normalizer"):
        raise ValueError("a vocabulary that normalises text cannot be decoded to its text")
    pre = spec.get("pre_tokenizer") or {}
    steps = pre["pretokenizers"] if pre.get("type") == "Sequence" else [pre]
    if any(s.get("add_prefix_space") for s in steps) or steps[-1].get("type") != "ByteLevel":
        raise ValueError("not a byte-level vocabulary without a leading blank")
    if len(steps) == 1 and steps[0].get("use_regex", True):
        return BYTE_LEVEL
    first = steps[0]
    if len(steps) == 2 and not steps[1].get("use_regex", True) and first.get("type") == "Split" and first.get("behavior") == "Isolated" and not first.get("invert"):
        return first["pattern"].get("Regex") or re.escape(first["pattern"]["String"])
    raise ValueError("unknown pre-split steps")


class Automaton:
    """The compiled merges of one vocabulary."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, chars = spec["model"]["vocab"], spec["model"]["merges"], _byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in vocab.items():
            self.label[i] = bytes(chars[c] for c in text)
        for text, i in self.special.items():
            self.label[i] = text.encode()
        self.tokens = {self.label[i]: i for t, i in vocab.items() if len(t) == 1}
        self._compile(vocab, merges)
        self._trie()
        self.pattern = split_pattern(spec)
        self.split = regex.compile(self.pattern).findall
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.labels = pa.array(self.label, type=pa.binary())

    # ------------------------------------------------------------ compilation

    def _compile(self, vocab: dict[str, int], merges: list) -> None:
        left: dict[int, int] = {}
        right: dict[int, int] = {}
        rank: dict[int, int] = {}
        cut: dict[tuple[int, int], int] = {}
        parent, lost = [0], [(-1, 0)]  # of each state: what it was copied from, and the arc and rank it lost
        behind = dict.fromkeys(self.tokens.values(), 0)  # the state that each label leads to

        def has_arc(last: int, token: int) -> bool:
            """Whether the state behind ``last`` has the arc ``token`` now; it has lost the cuts of its ancestors."""
            r, until_r = last, _NEVER
            while True:
                x, until_x = token, _NEVER
                while True:
                    k = cut.get((r, x))
                    if k is not None and k < until_r and k <= until_x:
                        return False
                    until_x = rank.get(x, -1)
                    if until_x < 0:
                        break
                    x = left[x]
                until_r = rank.get(r, -1)
                if until_r < 0:
                    return True
                r = right[r]

        for k, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u in behind and v in behind and self.label[w] not in self.tokens and has_arc(u, v):  # the gadget of rank k
                cut[u, v] = k
                left[w], right[w], rank[w] = u, v, k
                self.tokens[self.label[w]] = w
                behind[w] = behind[v]
                parent.append(behind[u])
                lost.append((v, k))
                behind[u] = len(parent) - 1

        # places: a token, then the tokens that grow out of it on the right, those of the highest rank first
        children: dict[int, list[int]] = {}
        for w in sorted(rank, key=rank.__getitem__, reverse=True):
            children.setdefault(left[w], []).append(w)
        place, end, n = {}, {}, 0
        for top in [t for t in behind if t not in left]:
            todo = [(top, False)]
            while todo:
                t, done = todo.pop()
                if done:
                    end[t] = n
                    continue
                place[t] = n
                n += 1
                todo.append((t, True))
                todo += [(c, False) for c in reversed(children.get(t, []))]
        falling = {t: [-rank[c] for c in cs] for t, cs in children.items()}

        def lost_interval(v: int, k: int) -> tuple[int, int]:
            later = bisect_right(falling.get(v, []), -k)  # children of rank k or more
            cs = children.get(v, [])
            return place[v], place[cs[later]] if later < len(cs) else end[v]

        ends: dict[int, list[int]] = {0: []}  # state -> sorted ends of its lost intervals

        def intervals(state: int) -> list[int]:
            chain = []
            while state and state not in ends:
                chain.append(state)
                state = parent[state]
            spans = list(zip(ends[state][::2], ends[state][1::2])) if state in ends else []
            spans = sorted([*spans, *(lost_interval(*lost[s]) for s in chain)])
            flat: list[int] = []
            for a, b in spans:
                if flat and a <= flat[-1]:
                    flat[-1] = max(flat[-1], b)
                else:
                    flat += (a, b)
            return flat

        size = len(self.label)
        self.place = np.zeros(size, dtype=np.int64)
        for t, p in place.items():
            self.place[t] = p
        # one row of interval ends for each state that a label leads to; labels that lead to the same share it
        self.row = np.zeros(size, dtype=np.int64)
        rows = sorted(set(behind.values()))
        number = {s: i for i, s in enumerate(rows)}
        flat = []
        for s in rows:
            ends[s] = intervals(s)
            flat.append(np.array(ends[s], dtype=np.int64) + (number[s] << _SHIFT))
        self.ends = np.concatenate(flat)
        for t, s in behind.items():
            self.row[t] = number[s] << _SHIFT

    def _trie(self) -> None:
        """The suffix table: per byte the node behind it, per node its longest token, per token the next shorter one."""
        child: list[dict[int, int]] = [{}]
        token = [-1]
        for text, t in self.tokens.items():
            at = 0
            for b in text:
                to = child[at].get(b)
                if to is None:
                    to = child[at][b] = len(child)
                    child.append({})
                    token.append(-1)
                at = to
            token[at] = t
        inner = [k for k, c in enumerate(child) if c]
        row = np.zeros(len(child), dtype=np.int32)
        row[inner] = np.arange(len(inner))
        go = np.zeros((len(inner), 256), dtype=np.int32)
        longest = np.full(len(child), -1, dtype=np.int32)
        self.shorter = np.full(len(self.label), -1, dtype=np.int32)
        fail = [0] * len(child)
        for b, k in child[0].items():
            go[0, b] = k
        level = [0]
        while level:
            below = []
            for at in level:
                if at:
                    f = fail[at]
                    rest = longest[f]
                    longest[at] = token[at] if token[at] >= 0 else rest
                    if token[at] >= 0:
                        self.shorter[token[at]] = rest
                    if child[at]:
                        r = go[row[at]]
                        r[:] = go[row[f]]
                        for b, k in child[at].items():
                            fail[k] = int(r[b])
                            r[b] = k
                    else:
                        row[at] = row[f]  # a leaf goes on where its longest suffix does
                below += child[at].values()
            level = below
        self.node_row, self.go, self.longest = row.astype(np.int64) << 8, go.ravel(), longest
        self.sizes = np.array([len(x) for x in self.label], dtype=np.int64)

    # ------------------------------------------------------------ transitions

    def arcs(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the states behind ``last`` have the arcs ``token``."""
        return np.searchsorted(self.ends, self.row[last] + self.place[token], side="right") & 1 == 0

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-split word, as little-endian 32-bit bytes."""
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out: list[bytes] = [b""] * len(words)
        for k in np.flatnonzero(n > SIDE_BY_SIDE).tolist():
            out[k] = self._encode_long(words[k])
        where = np.flatnonzero((n > 0) & (n <= SIDE_BY_SIDE))
        where = where[np.argsort(-n[where], kind="stable")]
        if not len(where):
            return out
        size = n[where]
        text = np.frombuffer(b"".join([words[k] for k in where.tolist()]), dtype=np.uint8)
        start = np.cumsum(size) - size
        last = np.zeros(len(text), dtype=np.int32)  # the token that ends with each byte
        node = np.zeros(len(size), dtype=np.int64)
        for e in range(int(size[0])):
            m = int(np.searchsorted(-size, -e, side="left"))  # words longer than e
            node[:m] = self.go[self.node_row[node[:m]] + text[start[:m] + e]]
            token = self.longest[node[:m]]
            if (token < 0).any():
                raise ValueError("the vocabulary has no token for a byte")
            todo = np.flatnonzero(self.sizes[token] <= e)  # others reach back to the word's begin
            while len(todo):
                t = token[todo]
                if (t < 0).any():
                    raise ValueError("the vocabulary has no token for a byte")
                before = e - self.sizes[t]
                ok = before < 0
                inside = np.flatnonzero(~ok)
                ok[inside] = self.arcs(last[start[todo[inside]] + before[inside]], t[inside])
                todo = todo[~ok]
                token[todo] = self.shorter[token[todo]]
            last[start[:m] + e] = token
        # the paths, from their ends
        steps, owners, at, live = [], [], size - 1, np.arange(len(size))
        while len(live):
            t = last[start[live] + at[live]]
            steps.append(t)
            owners.append(live)
            at[live] -= self.sizes[t]
            live = live[at[live] >= 0]
        owner = np.concatenate(owners)
        order = np.lexsort((-np.arange(len(owner)), owner))
        raw = np.concatenate(steps)[order].astype("<u4").tobytes()
        stop = (np.cumsum(np.bincount(owner, minlength=len(size))) * 4).tolist()
        for k, a, b in zip(where.tolist(), [0, *stop], stop):
            out[k] = raw[a:b]
        return out

    def _encode_long(self, word: bytes) -> bytes:
        """One long word by the same tables, byte by byte."""
        go, node_row, longest, shorter, sizes, row, place = self.go, self.node_row, self.longest, self.shorter, self.sizes, self.row, self.place
        known: dict[int, bool] = {}
        last, node = np.zeros(len(word), dtype=np.int32), 0
        for e, b in enumerate(word):
            node = go[node_row[node] + b]
            t = int(longest[node])
            while t >= 0 and (before := e - int(sizes[t])) >= 0:
                key = int(row[last[before]] + place[t])
                ok = known.get(key)
                if ok is None:
                    ok = known[key] = not int(np.searchsorted(self.ends, key, side="right")) & 1
                if ok:
                    break
                t = int(shorter[t])
            if t < 0:
                raise ValueError("the vocabulary has no token for a byte")
            last[e] = t
        path, at = [], len(word) - 1
        while at >= 0:
            path.append(int(last[at]))
            at -= int(sizes[path[-1]])
        return np.array(path[::-1], dtype="<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of text that pre-splitting cuts alike on their own: a special string, or words."""
        if not pieces:
            return []
        plain = pc.match_substring_regex(pa.array([p[1:] for p in pieces], type=pa.string()), _LETTERS).to_numpy(zero_copy_only=False) if self.pattern == BYTE_LEVEL else np.zeros(len(pieces), dtype=bool)
        words, counts = [], []
        for p, one in zip(pieces, plain.tolist()):
            if one and p[0] == " ":
                words.append(p)
                counts.append(1)
            elif p in self.special:
                counts.append(-1)
            else:
                found = self.split(p)
                words += found
                counts.append(len(found))
        distinct = list(dict.fromkeys(words))
        ids = dict(zip(distinct, self.encode_words([w.encode("utf-8") for w in distinct])))
        out, at = [], 0
        for p, c in zip(pieces, counts):
            if c < 0:
                out.append(np.array([self.special[p]], dtype="<u4").tobytes())
                continue
            out.append(ids[words[at]] if c == 1 else b"".join([ids[w] for w in words[at : at + c]]))
            at += c
        return out


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(path)


@lru_cache(maxsize=4)
def _memo(path: str) -> C.TwoGenerations:
    return C.TwoGenerations(MEMO_WORDS, MEMO_BYTES)


C.remembers((__name__,), _memo.cache_clear)  # the automaton stays: compiling it again costs more than its tables hold

#: White space beyond the blank; a text with two white-space characters in a row is pre-split as a whole.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BLANK_RUNS = ["  ", *(f" {c}" for c in "\t\n\v\f\r"), *(f"{c} " for c in "\t\n\v\f\r")]


def blank_cuts_are_safe(text: str) -> bool:
    """Whether every blank stands between two non-space characters: then each blank starts a pre-split word."""
    if text[:1] == " " or text[-1:] == " " or any(r in text for r in _BLANK_RUNS):
        return False
    return text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") or not _OTHER_SPACE.search(text)


class Encoder:
    """Texts to ids."""

    def __init__(self, path: str):
        self.auto, self.memo = automaton(path), _memo(path)

    def _words(self, text: str) -> list[str]:
        """Special strings and pre-split words of a text."""
        auto = self.auto
        out: list[str] = []
        for i, part in enumerate(auto.marks.split(text) if auto.marks else [text]):
            out += [part] if i % 2 else auto.split(part)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in order, ids before each text and the end)."""
        auto = self.auto
        texts = [t or "" for t in texts]
        # runs of blanks are words of their own in the byte-level pattern only
        by_blanks = auto.pattern == BYTE_LEVEL
        safe = [by_blanks and t != "" and not any(s in t for s in auto.special) and blank_cuts_are_safe(t) for t in texts]
        split = pc.split_pattern(pa.array([t for t, s in zip(texts, safe) if s], type=pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        other = [self._words(t) for t, s in zip(texts, safe) if not s]
        rest = pa.array([w for ws in other for w in ws], type=pa.string()).dictionary_encode()
        first = np.asarray(split.offsets, dtype=np.int64) if any(safe) else np.zeros(1, dtype=np.int64)
        heads = pa.array([t.split(" ", 1)[0] for t, s in zip(texts, safe) if s], type=pa.string()).dictionary_encode()
        keys = [f" {w}" for w in coded.dictionary.to_pylist()] + heads.dictionary.to_pylist() + rest.dictionary.to_pylist()
        distinct = list(dict.fromkeys(keys))
        known = dict(zip(distinct, self.memo.values(distinct, auto.encode_pieces)))
        values = pa.array(list(map(known.__getitem__, keys)), type=pa.binary())
        # pieces of the safe texts, then words of the others
        index = np.asarray(coded.indices, dtype=np.int64).copy()
        index[first[:-1]] = len(coded.dictionary) + np.asarray(heads.indices, dtype=np.int64)
        index = np.concatenate([index, len(coded.dictionary) + len(heads.dictionary) + np.asarray(rest.indices, dtype=np.int64)])
        counts = np.zeros(len(texts), dtype=np.int64)
        safe_at = np.array(safe, dtype=bool)
        counts[safe_at], counts[~safe_at] = np.diff(first), [len(ws) for ws in other]
        begin = np.zeros(len(texts), dtype=np.int64)
        begin[safe_at] = first[:-1]
        begin[~safe_at] = first[-1] + np.cumsum(counts[~safe_at]) - counts[~safe_at]
        if not safe_at.all():  # back into the order of the texts
            index = index[np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(index))]
        ids = values.take(pa.array(index))
        at = np.frombuffer(ids.buffers()[1], dtype=np.int32, count=len(ids) + 1) if len(ids) else np.zeros(1, dtype=np.int32)
        at = at[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64) // 4
        return np.frombuffer(ids.buffers()[2], dtype="<u4", count=int(at[-1])) if at[-1] else np.empty(0, dtype="<u4"), at

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The text of each document in UTF-8: the labels of its arcs."""
        if not len(ids):
            return [b""] * (len(at) - 1)
        emitted = self.auto.labels.take(pa.array(ids))
        place = np.frombuffer(emitted.buffers()[1], dtype=np.int32, count=len(emitted) + 1)[at].tolist()
        raw = emitted.buffers()[2].to_pybytes()
        out = []
        for a, b in zip(place, place[1:]):
            text = raw[a:b]
            try:
                text.decode("utf-8")
            except UnicodeDecodeError:
                text = text.decode("utf-8", "replace").encode("utf-8")
            out.append(text)
        return out


def _encode_batch(path: str, outputs: tuple[str, ...]):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = Encoder(path)
        ids, at = enc.encode(batch.column(1).to_pylist())
        raw, cut = ids.tobytes(), (at * 4).tolist()
        digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut, cut[1:])]
        texts = enc.decode(ids, at)
        counts = np.diff(at)
        cols = [batch.column(0), pa.array(counts), pa.array(digests, type=pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], type=pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if "ids" in outputs:
            cols.append(C.list_array(ids.view("<i4"), counts))
        if "decoded" in outputs:
            cols.append(pa.array([t.decode("utf-8") for t in texts], type=pa.string()))
        return pa.RecordBatch.from_arrays(cols, names=[*names, *outputs])

    return fn


def encode_decode(docs: DataFrame, vocabulary: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, as asked for in ``outputs``, ``ids`` and ``decoded``."""
    kinds = {"ids": "array<int>", "decoded": "string"}
    schema = ", ".join(["doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", *(f"{c} {kinds[c]}" for c in outputs)])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return C.map_arrow(texts, _encode_batch(vocabulary or default_vocabulary(), outputs), schema, SLICE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(C.documents_of(spark, sf_dir), outputs=())
