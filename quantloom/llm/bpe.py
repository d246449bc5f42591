"""Byte-pair encoding and decoding in batched numpy merge rounds.

Texts are cut into words by the tokenizer's own rules. The distinct unknown words of a batch become one flat array of
symbols with word boundaries. In each round every unfinished word looks at the ranks of its neighbouring pairs, found
by binary search over the sorted pair keys, and merges its leftmost pair of the lowest rank; words without a pair that
may merge leave the array. Only pairs beside a merge are looked up again. The ids of a word are then kept for later
batches, in a table of bounded size.

There is no shuffle: each task reads its documents and writes rows of the same order of size. The tokenizer file is
read once by the driver and broadcast (its size is fixed by the tokenizer, not by the corpus), so that executors need
no copy. Texts are worked on in blocks of `BLOCK_CHARS`; a longer text is a block of its own.

Supported: tokenizers of the kind "word ends": NFC, lower case, one split pattern, byte-level symbols, an
end-of-word suffix, no post-processor, no decoder (decoding joins the tokens with blanks). Special tokens that are
written out in a text become their ids, as in the tokenizers library.

Defined cases: NULL and empty texts, and texts of white space only, have no ids and decode to an empty text; repeated
rows are encoded alike; an empty table gives no rows; the operator emits only its own columns beside the id.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# The helpers travel with the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of text that are cut into words at once.
BLOCK_CHARS = 2_000_000
#: Words whose ids a worker keeps.
KEPT_WORDS = 300_000

_NO_RANK = np.iinfo(np.int64).max


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    stand_in = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [stand_in[b] for b in range(256)]


def _latin_pattern(pattern: str) -> str:
    """The split pattern for texts of the first 256 characters, its classes spelt out for the faster engine."""
    latin = list(map(chr, range(256)))
    spelt = lambda chars: "".join(map(re.escape, chars))
    letters = spelt(c for c in latin if unicodedata.category(c)[0] == "L")
    numbers = spelt(c for c in latin if unicodedata.category(c)[0] == "N")
    spaces = spelt(c for c in latin if regex.match(r"\p{White_Space}", c))
    return pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", spaces)


class WordEndTokenizer:
    """Encodes and decodes with the tables of a tokenizer file (its JSON text)."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not suffix or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("not a tokenizer of the word-end kind")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # \s of the library's engine is the Unicode property; regex's own also has some control characters.
        self.cut = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}")).findall
        self.cut_latin = re.compile(_latin_pattern(pattern)).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.base = 1 + max(vocab.values())
        keys = left * self.base + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], _NO_RANK)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (UTF-8) one after another, and where each word's ids end."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes) - 1
        symbols = self.inner[flat]
        symbols[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        ranks = np.full(len(symbols), _NO_RANK)  # of the pair that begins here
        inside = np.flatnonzero(word[:-1] == word[1:])
        ranks[inside] = self._ranks(symbols[inside], symbols[inside + 1])
        done_word, done_ids = [], []

        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            least = np.minimum.reduceat(ranks, starts)
            over = least == _NO_RANK
            if over.any():
                keep = np.repeat(~over, sizes)
                done_word.append(word[~keep])
                done_ids.append(symbols[~keep])
                symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
                least, sizes = least[~over], sizes[~over]
                if not len(symbols):
                    break
            hits = np.flatnonzero(ranks == np.repeat(least, sizes))
            hits = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]  # the leftmost of each word
            symbols[hits] = self.merged[ranks[hits]]
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            moved = np.cumsum(stay) - 1
            symbols, word, ranks = symbols[stay], word[stay], ranks[stay]
            at = moved[hits]
            for pair in (at, at[at > 0] - 1):
                live = pair[pair + 1 < len(word)]
                live = live[word[live] == word[live + 1]]
                ranks[pair] = np.where(np.isin(pair, live, assume_unique=True), ranks[pair], _NO_RANK)
                ranks[live] = self._ranks(symbols[live], symbols[live + 1])
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_ids)[order], np.cumsum(np.bincount(word, minlength=len(words)))

    def words(self, text: str) -> list[str]:
        """The words and written-out special tokens of a text, in order."""
        found: list[str] = []
        for part in self.at_special.split(text):
            if part in self.special:
                found.append(part)
            elif part:
                try:
                    part.encode("latin-1")
                    found += self.cut_latin(part.lower())
                except UnicodeEncodeError:
                    # Every capital sigma becomes the same small one; str.lower() treats word ends apart.
                    found += self.cut(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return found

    def learn(self, words: set[str]) -> None:
        """Put the ids and the decoded form of these words into the table."""
        new = words.difference(self.ids_of)
        if len(self.ids_of) + len(new) > KEPT_WORDS:
            self.ids_of.clear()
            self.text_of.clear()
            new = words
        for w in new & self.special.keys():
            self.ids_of[w], self.text_of[w] = np.array([self.special[w]], "<u4").tobytes(), w
        new = list(new - self.special.keys())
        if new:
            ids, ends = self.merge_words([w.encode() for w in new])
            data, tokens = ids.astype("<u4").tobytes(), list(map(self.tokens.__getitem__, ids.tolist()))
            start = 0
            for w, end in zip(new, ends.tolist(), strict=True):
                self.ids_of[w] = data[4 * start : 4 * end]
                self.text_of[w] = " ".join(tokens[start:end])
                start = end

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[int, bytes, str]]:
        """Per text: number of ids, ids as little-endian unsigned 32-bit integers, decoded text."""
        block: list[list[str]] = []
        chars = 0
        for i, text in enumerate(texts):
            block.append(self.words(text))
            chars += len(text)
            if chars >= BLOCK_CHARS or i == len(texts) - 1:
                self.learn(set().union(*block))
                for words in block:
                    ids = b"".join(map(self.ids_of.__getitem__, words))
                    yield len(ids) // 4, ids, " ".join(map(self.text_of.__getitem__, words))
                block, chars = [], 0

    def decode(self, ids: bytes) -> str:
        """The text of ids as the library joins it, special tokens included."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _tokenizer(shared) -> WordEndTokenizer:
    """One tokenizer for each Python worker: workers outlive tasks, and so does what hangs on a module they all have."""
    loaded = sys.__dict__.setdefault("_quantloom_tokenizers", {})
    key = hash(shared.value)
    if key not in loaded:
        loaded.clear()
        loaded[key] = WordEndTokenizer(shared.value)
    return loaded[key]


def _over_texts(docs: DataFrame, path: str, columns: str, rows) -> DataFrame:
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared)
        for batch in batches:
            # Slices keep what is held at once to a few blocks, however long the texts are.
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield rows(part.column("doc_id"), tokenizer.encode_batch(texts), tokenizer)

    return docs.select("doc_id", "text").mapInArrow(run, columns)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every document (doc_id, text)."""

    def rows(ids, found, _):
        found = list(found)
        arrays = [np.frombuffer(f[1], "<u4").astype(np.int32) for f in found]
        offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        flat = pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
        return pa.RecordBatch.from_arrays([ids, lists, pa.array([f[2] for f in found], pa.string())], ["doc_id", "ids", "decoded"])

    return _over_texts(docs, path, "doc_id long, ids array<int>, decoded string", rows)


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""

    def rows(ids, found, _):
        counts, id_digests, text_digests = [], [], []
        for n, data, text in found:
            counts.append(n)
            id_digests.append(hashlib.sha256(data).hexdigest())
            text_digests.append(hashlib.sha256(text.encode()).hexdigest())
        columns = [ids, pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _over_texts(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
