"""Token counts with a whole-token shortcut.

Merging is needed only to learn how many tokens a pre-token has. For every
vocabulary string that spells a whole pre-token the answer is found once, on
the driver: it is encoded alone, and those that give one token are proven.
Workers cut a text into pre-tokens as the library would, count the proven ones
directly, and merge each distinct other one once.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from operator import mul

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import byte_characters
from .common import bytes_of, col, free_name, frugal, in_runs, small_batches, table

VOCABULARY = "word_bpe_49k.json"
REMEMBERED = 600_000
#: Characters below U+0300 keep their form under NFC, lower-case one by one, and
#: both regular-expression engines class them alike, but for these few.
PLAIN_ONLY = regex.compile(r"[\x1c-\x1f\x85\xb5İ]|[^\x00-˿]")
#: Blocks whose characters neither combine with a neighbour nor change with one
#: (but for the capital sigma): Latin, Greek, Cyrillic, punctuation, signs, kana,
#: Han, Hangul syllables, pictures. Each is proven on the driver, one by one; a
#: text with any other character goes through the library whole.
WIDE = ((0x100, 0x24F), (0x384, 0x3A2), (0x3A4, 0x3FF), (0x400, 0x52F), (0x1E00, 0x1EFF), (0x2010, 0x2060), (0x20A0, 0x20C0), (0x2100, 0x27BF), (0x3001, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1FAFF))


class WordCounter:
    """Counts tokens as the library does; one per worker and file."""

    def __init__(self, path: str, proven: frozenset[str] | None = None, wide: frozenset[str] | None = None):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.merge, self.characters = self.tokenizer.model.tokenize, byte_characters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The shortcut below holds for this kind of file alone.
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or split["behavior"] != "Removed" or spec["model"]["end_of_word_suffix"] is None:
            raise ValueError(f"{path} is not a lower-casing word BPE file")
        if [(n["type"], n["add_prefix_space"], n["use_regex"]) for n in spec["pre_tokenizer"]["pretokenizers"][1:]] != [("ByteLevel", False, False)]:
            raise ValueError(f"{path} does not spell pieces in byte characters")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.cut = self.pattern.findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.suffix, self.vocabulary = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.wide = self.prove_characters() if wide is None else wide
        self.proven = self.prove() if proven is None else proven
        self.forget()

    def forget(self) -> None:
        """Starts the memory anew: proven pieces are one token."""
        self.known = dict.fromkeys(self.proven, 1)

    def alone(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def merged(self, piece: str) -> int:
        """Tokens of a pre-token. It keeps its form and is not cut again, so the model alone gives them."""
        return len(self.merge("".join([self.characters[b] for b in piece.encode()])))

    def prove_characters(self) -> frozenset[str]:
        """Characters beyond the plain ones that the library changes and cuts as Python does.

        Alone, each keeps its form, gives one character in lower case, and is
        classed as a letter, a number or neither by both engines: its pieces are
        the same between letters and between marks.
        """
        normal, cut = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        out = []
        for a, b in WIDE:
            for c in map(chr, range(a, b + 1)):
                low = c.lower()
                if unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c or len(low) != 1 or unicodedata.normalize("NFC", low) != low or normal(c) != low:
                    continue
                if all(len(cut(t)) == len(self.cut(t)) for t in (f"a{low}a", f"-{low}-", f"1{low}1", low)):
                    out.append(c)
        return frozenset(out)

    def prove(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and, encoded alone, one token."""
        back = {c: b for b, c in enumerate(byte_characters())}
        words = []
        for entry in self.vocabulary:
            if entry.endswith(self.suffix):
                raw = bytes(back[c] for c in entry.removesuffix(self.suffix) if c in back)
                try:
                    word = raw.decode()
                except UnicodeDecodeError:
                    continue
                if self.cut(word) == [word] and not PLAIN_ONLY.search(word):
                    words.append(word)
        return frozenset(w for w, n in zip(words, self.alone(words), strict=True) if n == 1)

    def by_pieces(self, text: str) -> bool:
        """Whether every character is plain or proven, and no special string is inside."""
        if PLAIN_ONLY.search(text) and not all(c in self.wide or not PLAIN_ONLY.match(c) for c in set(text)):
            return False
        return not any(s in text for s in self.special)

    def count(self, text: str) -> int:
        if not self.by_pieces(text):
            return self.alone([text])[0]
        total = 0
        for pieces in in_runs(self.pattern, text.lower()):
            counts = Counter(pieces)
            try:
                total += sum(map(mul, map(self.known.__getitem__, counts), counts.values()))
                continue
            except KeyError:
                pass
            if len(self.known) > REMEMBERED:
                self.forget()
            new = [p for p in counts if p not in self.known]
            self.known.update(zip(new, map(self.merged, new), strict=True))
            total += sum(map(mul, map(self.known.__getitem__, counts), counts.values()))
        return total


@functools.cache
def loaded(path: str, proven: frozenset[str], wide: frozenset[str]) -> WordCounter:
    return WordCounter(path, proven, wide)


def count_tokens(df: DataFrame, text: str = "text", *, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes (UTF-8) and n_tokens of every whole text; null counts as empty.

    Columns called n_bytes or n_tokens are not kept. Repeated rows stay; an
    empty table gives an empty result; a long text is read in runs of its
    pieces. The proven strings and characters travel to the workers once, as a
    broadcast bounded by the vocabulary and the fixed blocks of characters.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    here = WordCounter(path)
    proven = small_batches(df).sparkSession.sparkContext.broadcast((here.proven, here.wide))
    keep = tuple(c for c in keep if c not in ("n_bytes", "n_tokens"))
    fields = [df.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path, *proven.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n = np.fromiter((counter.count(t.as_py() or "") for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=[*batch.schema.names[:-1], "n_tokens"])

    narrow = df.select(*map(col, keep), bytes_of(col(text)).alias("n_bytes"), col(text).alias(free_name(df, "_text")))
    return narrow.mapInArrow(frugal(run, lambda: loaded(path, *proven.value).forget()), T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they pass 2048."""
    counted = count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
