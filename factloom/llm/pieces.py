"""Library ids of texts by their pieces between ASCII white space, for vocabularies that drop white space.

Such a vocabulary never joins across white space, so a text's ids are those of its pieces, one after the other. Arrow
splits a batch and numbers its distinct pieces; the library encodes each distinct piece once, a bounded memo keeps the
results, and Arrow's ``take`` lays them out again. Other vocabularies encode whole texts.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from factloom.llm import common as C

MEMO_PIECES, MEMO_BYTES = 500_000, 64 << 20
#: Bytes of text that are split together: the larger, the fewer pieces are looked up again.
SLICE = 8 << 20
#: Pieces that the library sees at once; pieces of these letters alone are one word each in every Unicode version.
RUN, _LETTERS = 4_000, "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"


@lru_cache(maxsize=2)
def library(path: str):
    """The library's tokenizer, one thread, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    suffix = model.get("end_of_word_suffix")
    ends = np.zeros(library(path).get_vocab_size(), dtype=bool)
    if suffix:
        ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
    marks = [(t["content"], t["id"]) for t in spec.get("added_tokens", []) if t.get("special") and not t.get("normalized") and not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word")]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    first = steps[0]
    regex = (first.get("pattern") or {}).get("Regex", "") if first.get("type") == "Split" else ""
    drops = first.get("behavior") == "Removed" and bool(first.get("invert")) and r"[^\s\p{L}\p{N}]+" in regex and " ?" not in regex
    return {"ends": ends if suffix else None, "mark": marks[0] if marks else None, "specials": [m for m, _ in marks], "drops": drops}


def drops_white_space(path: str) -> bool:
    """Whether tokens of this vocabulary never touch white space: it is normalised to blanks and split away."""
    return _spec(path)["drops"]


@lru_cache(maxsize=4)
def _memo(path: str) -> C.TwoGenerations:
    return C.TwoGenerations(MEMO_PIECES, MEMO_BYTES)


C.remembers(("factloom.llm.token_counts", "factloom.llm.bit_packing"), library.cache_clear, _memo.cache_clear)


def _encoded(path: str, texts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, dtype="<u4") for e in library(path).encode_batch_fast(texts, add_special_tokens=False)]


def _cut(ids: np.ndarray, after: np.ndarray) -> list[bytes]:
    """``ids`` cut after the positions ``after`` (the last one is its end)."""
    raw, ends = ids.tobytes(), ((after + 1) * 4).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _encode_pieces(path: str, pieces: list[str]) -> list[bytes]:
    """Ids of each piece. Many pieces go to the library as one text: words of letters are told apart by the ends of
    words, other pieces by a special token between them; what cannot be told apart so is encoded on its own."""
    spec = _spec(path)
    out: list[bytes | None] = [None] * len(pieces)
    plain = pc.match_substring_regex(pa.array(pieces, type=pa.string()), _LETTERS).to_numpy(zero_copy_only=False) if pieces else np.zeros(0, dtype=bool)
    if spec["ends"] is not None:
        where = np.flatnonzero(plain).tolist()
        for k in range(0, len(where), RUN):
            run = where[k : k + RUN]
            (ids,) = _encoded(path, [" ".join([pieces[i] for i in run])])
            last = np.flatnonzero(spec["ends"][ids])
            if len(last) == len(run):
                for i, b in zip(run, _cut(ids, last)):
                    out[i] = b
    rest = [i for i, b in enumerate(out) if b is None]
    if spec["mark"]:
        text, number = spec["mark"]
        apart = [i for i in rest if not any(m in pieces[i] for m in spec["specials"])]
        for k in range(0, len(apart), RUN):
            run = apart[k : k + RUN]
            (ids,) = _encoded(path, [text.join([*(pieces[i] for i in run), ""])])
            last = np.flatnonzero(ids == number)
            if len(last) == len(run):
                for i, b in zip(run, _cut(ids, last)):
                    out[i] = b[:-4]
        rest = [i for i in rest if out[i] is None]
    for i, ids in zip(rest, _encoded(path, [pieces[i] for i in rest])):
        out[i] = ids.tobytes()
    return out


def encode(path: str, texts: pa.Array) -> tuple[pa.BinaryArray, np.ndarray]:
    """(ids of each piece as little-endian 32-bit bytes, in order; first piece of each text, and the end)."""
    texts = pc.fill_null(texts, "")
    if not drops_white_space(path):
        ids = [b.tobytes() for b in _encoded(path, texts.to_pylist())]
        return pa.array(ids, type=pa.binary()), np.arange(len(texts) + 1)
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    values = _memo(path).values(coded.dictionary.to_pylist(), lambda new: _encode_pieces(path, new))
    first = np.asarray(split.offsets, dtype=np.int64)
    return pa.array(values, type=pa.binary()).take(coded.indices), first - first[0]


def _bounds(ids: pa.BinaryArray, first: np.ndarray) -> np.ndarray:
    """Tokens before each text, and the end."""
    at = np.frombuffer(ids.buffers()[1], dtype=np.int32, count=len(ids) + 1, offset=4 * ids.offset) if len(ids) else np.zeros(1, dtype=np.int32)
    return (at[first].astype(np.int64) - int(at[0])) // 4


def count_tokens(path: str, texts: pa.Array) -> np.ndarray:
    """Tokens of each text."""
    return np.diff(_bounds(*encode(path, texts)))


def encode_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of all texts in order, tokens before each text and the end)."""
    ids, first = encode(path, texts)
    at = _bounds(ids, first)
    if not at[-1]:
        return np.empty(0, dtype="<u4"), at
    start = int(np.frombuffer(ids.buffers()[1], dtype=np.int32, count=1, offset=4 * ids.offset)[0])
    return np.frombuffer(ids.buffers()[2], dtype="<u4", count=int(at[-1]), offset=start), at
