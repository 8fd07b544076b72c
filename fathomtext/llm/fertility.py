"""Quality rules by tokeniser fertility.

Two public vocabularies cut each text. A byte-level one made for many languages gives
characters per token and the entropy of the tokens; one of pieces, which writes a character
that it doesn't know as its bytes, gives the share of tokens that are such a byte fallback
(of characters beyond ASCII; line ends are bytes there, too, and say nothing). Text that
reads as natural language of a script gives a steady number of characters per token, little
byte fallback, and a token distribution whose entropy is high for its length. Bands per
script say what is usual; a text outside its script's band on any measure is rejected.
Counts of words, symbols, repeated lines and repeated windows stand beside them (base rules).

Bands are fixed per script, not fitted to the table at hand, so a document's verdict
depends on that document and the vocabularies alone.

Defined cases: null or empty text has zeros everywhere and fails the base rule on words;
repeated rows are judged each on its own; other columns, whatever their names, are only
carried; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomtext.llm._spark import lean
from fathomtext.llm._words import Words, mix, word_slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"  # byte-level, with public_tokenizers.PATTERN
PIECES = "piece_bpe_32k.model"  # pieces with byte fallback


#: fixed values: numbers of tokens that entropy floors are given for, each twice the one before
AT = [32, 64, 128, 256, 512, 1024, 2048, 4096]


@dataclass(frozen=True)
class Band:
    """What is usual: characters a token (least, most), most byte fallback, least entropy.

    The entropy is in parts of its largest value at the text's length, log2(min(tokens, 1024)). These parts still
    fall with length in clean prose, so least_entropy has a floor for each of AT tokens, straight between them in
    log2(tokens) and level outside; one value alone holds for any length. The least characters are for a long text; they are lowered by 2 / sqrt(tokens), as short texts vary."""

    least_chars: float
    most_chars: float
    most_fallback: float
    least_entropy: float | tuple[float, ...]

    def floors(self) -> list[float]:
        return list(self.least_entropy) if isinstance(self.least_entropy, tuple) else [self.least_entropy] * len(AT)


#: fixed values: by script of most letters; "other" for the rest, "none" for texts without letters
BANDS = {
    "latin": Band(2.05, 8.0, 0.05, (0.78, 0.78, 0.76, 0.725, 0.685, 0.64, 0.64, 0.65)),
    "cyrillic": Band(1.0, 8.0, 0.05, 0.45),
    "greek": Band(0.8, 8.0, 0.10, 0.45),
    "arabic": Band(0.8, 8.0, 0.10, 0.45),
    "hebrew": Band(0.7, 8.0, 0.15, 0.45),
    "cjk": Band(0.4, 4.0, 0.50, 0.45),
    "other": Band(0.25, 8.0, 0.95, 0.40),
    "none": Band(0.25, 8.0, 0.60, 0.45),
}
SCRIPTS = list(BANDS)
#: fixed values: first and last code point of the letter ranges
RANGES = [("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("other", 0x700, 0x1DFF), ("latin", 0x1E00, 0x1EFF), ("cjk", 0x3040, 0x30FF), ("cjk", 0x3400, 0x9FFF), ("cjk", 0xAC00, 0xD7AF), ("other", 0x10000, 0x1FFFF), ("cjk", 0x20000, 0x3FFFF)]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_FIRST = np.ones(256, bool)
_FIRST[0x80:0xC0] = False  # not the first byte of a code point
#: script of a letter by its UTF-8 lead byte and the next one (exact to 64 code points, enough to tell scripts apart)
_NONE = SCRIPTS.index("none")


def _lead_table() -> np.ndarray:
    table = np.full((256, 256), _NONE, np.int8)
    for name, a, b in RANGES:
        step = 1 if a < 0x80 else 64 if a < 0x10000 else 4096
        for code in {*range(a, b + 1, step), a, b}:
            e = chr(code).encode()
            if len(e) == 1:
                table[e[0], :] = SCRIPTS.index(name)
            elif len(e) == 2:
                table[e[0], e[1]] = SCRIPTS.index(name)
            else:
                table[e[0], e[1]] = SCRIPTS.index(name)
    for code in range(0xC0, 0x530):
        e = chr(code).encode()
        table[e[0], e[1]] = next((SCRIPTS.index(n) for n, a, b in RANGES if a <= code <= b), _NONE)
    return table


@lru_cache(maxsize=2)
def _encoders(byte_level: str, pieces: str):
    """The byte-level encoding, the piece model, and which of its tokens are bytes of characters beyond ASCII; read once a worker."""
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(byte_level, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    fallback = np.array([model.is_byte(i) and int(model.id_to_piece(i)[3:5], 16) >= 0x80 for i in range(model.get_piece_size())], bool)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), model, fallback


def script_of(w: Words, table: np.ndarray) -> np.ndarray:
    """Index in SCRIPTS of the script most letters of each row are of; ties go to the first in SCRIPTS."""
    n = len(w.rows) - 1
    lead = np.flatnonzero(w.data >= 0xC0)
    following = np.append(w.data, 0)[lead + 1]
    row = np.searchsorted(w.rows, lead, "right") - 1
    counts = np.bincount(row * len(SCRIPTS) + table[w.data[lead], following], minlength=n * len(SCRIPTS)).reshape(n, -1)
    total = np.concatenate([[0], np.cumsum(_LETTER[w.data], dtype=np.int64)])
    counts[:, SCRIPTS.index("latin")] += total[w.rows[1:]] - total[w.rows[:-1]]
    counts[:, _NONE] = 0
    return np.where(counts.sum(1) > 0, counts.argmax(1), _NONE)


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""

    def by_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[w.rows[1:]] - total[w.rows[:-1]]

    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.starts] += 1
    inside[w.ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    h, whole = w.windows(5)
    at = np.flatnonzero(whole)
    key = mix(h[at] ^ mix(w.row_of()[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    raw = w.data.tobytes()
    dup = np.zeros(len(w.rows) - 1, np.int64)
    for i in np.flatnonzero(by_row(w.data == 10)):
        lines = [x for x in raw[w.rows[i] : w.rows[i + 1]].split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
    return {"n_words": w.counts, "word_chars": by_row(inside & _FIRST[w.data]), "n_symbols": by_row(_SYMBOL[w.data]), "n_dup_lines": dup, "n_repeat_words": w.per_row(w.covered(at[twice], 5))}


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in ids], np.int64)
    return n, np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))


def flagged_share(ids: list[list[int]], flags: np.ndarray) -> np.ndarray:
    """Share of each text's tokens that are flagged."""
    n, flat = _flat(ids)
    total = np.concatenate([[0], np.cumsum(flags[flat], dtype=np.int64)])
    upto = np.concatenate([[0], np.cumsum(n)])
    return (total[upto[1:]] - total[upto[:-1]]) / np.maximum(n, 1)


def token_entropy(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and the entropy of their distribution as a part of its largest value."""
    n, flat = _flat(ids)
    width = int(flat.max(initial=0)) + 1
    key = np.sort(np.repeat(np.arange(len(n)), n) * width + flat)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    c = np.diff(np.append(first, len(key))).astype(float)
    r = key[first] // width
    total = np.maximum(n, 1)
    entropy = np.bincount(r, weights=-(c / total[r]) * np.log2(c / total[r]), minlength=len(n))
    return n, np.where(n > 1, entropy / np.log2(np.clip(n, 2, 1024)), 0.0)


def entropy_floor(script: np.ndarray, n: np.ndarray, bands: dict[str, Band] = BANDS) -> np.ndarray:
    """Least entropy of texts of n tokens, by their index in SCRIPTS."""
    floors = np.array([bands[name].floors() for name in SCRIPTS])
    x = np.log2(np.clip(n, AT[0], AT[-1])) - np.log2(AT[0])
    i = np.minimum(x.astype(np.int64), len(AT) - 2)
    return floors[script, i] + (x - i) * (floors[script, i + 1] - floors[script, i])


def broken_bands(m: dict[str, np.ndarray], bands: dict[str, Band] = BANDS) -> dict[str, np.ndarray]:
    """By measure, which texts are outside their script's band."""
    limits = np.array([[b.least_chars, b.most_chars, b.most_fallback] for b in (bands[name] for name in SCRIPTS)])[m["script"]]
    n = m["n_tokens"]
    return {
        "chars_low": m["chars_per_token"] < limits[:, 0] - 2 / np.sqrt(np.maximum(n, 1)),
        "chars_high": m["chars_per_token"] > limits[:, 1],
        "fallback": m["fallback_share"] > limits[:, 2],
        "entropy": m["token_entropy"] < entropy_floor(m["script"], n, bands),
    }


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def fertility(texts: list[str], w: Words, paths: tuple[str, str], table: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of the two vocabularies, and the script."""
    encoding, model, fallback = _encoders(*paths)
    n, entropy = token_entropy([encoding.encode_ordinary(x) for x in texts])
    chars = np.array([len(x) for x in texts], np.int64)
    pieces = model.encode(texts, num_threads=1)
    return {"n_tokens": n, "chars_per_token": chars / np.maximum(n, 1), "n_pieces": np.array([len(x) for x in pieces], np.int64), "fallback_share": flagged_share(pieces, fallback), "token_entropy": entropy, "script": script_of(w, table)}


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES)


FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, chars_per_token double, n_pieces bigint, fallback_share double, token_entropy double, script string, base_failed boolean, broken_bands string, kept boolean"


def quality(docs: DataFrame, paths: tuple[str, str] | None = None, bands: dict[str, Band] = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, base_failed, the bands a document breaks and kept, for each row of docs; one scan, no shuffle.

    paths: a byte-level vocabulary and a piece model with byte fallback."""
    paths = paths or vocabularies()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names = _lead_table(), np.array(SCRIPTS)
        for batch in batches:
            column = batch.column("text")
            for a, b, w in word_slices(column):
                m = base_counts(w) | fertility([x or "" for x in column.slice(a, b - a).to_pylist()], w, paths, table)
                failed, broken = base_failed(m), broken_bands(m, bands)
                said = [",".join(k for k, v in broken.items() if v[i]) for i in range(b - a)]
                m |= {"script": names[m["script"]].tolist(), "base_failed": failed, "broken_bands": said, "kept": ~failed & np.array([not x for x in said], bool)}
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(v) if isinstance(v, np.ndarray) else pa.array(v, pa.string()) for v in m.values())], names=["doc_id", *m])

    return own.mapInArrow(lean(run), f"doc_id {kind}, {FIELDS}")


def keep_good(docs: DataFrame, paths: tuple[str, str] | None = None, bands: dict[str, Band] = BANDS) -> DataFrame:
    """The rows whose text passes, with all their columns.

    The verdict is a function of the text, taken in the scan that reads it: rows travel through
    one Arrow stage whole, and nothing is shuffled or joined. Texts that break the base rules
    aren't cut into tokens."""
    paths = paths or vocabularies()
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _lead_table()
        for batch in batches:
            column = batch.column(place)
            for a, b, w in word_slices(column):
                good = ~base_failed(base_counts(w))
                m = fertility([x if g else "" for x, g in zip(column.slice(a, b - a).to_pylist(), good, strict=True)], w, paths, table)
                for v in broken_bands(m, bands).values():
                    good &= ~v
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(lean(run), docs.schema)
