"""BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word there is one token that can end its encoding: a vocabulary token that is a suffix of the
prefix, whose own encoding is itself, and that may stand after the last token of the prefix before it. An automaton over
the vocabulary lists the suffixes; a test of the two tokens tells whether merging would join their ends. Following the
stored tokens back from the end of the word gives exactly the ids that rank-ordered merging gives.

The vocabulary file is a parameter: a JSON file of a BPE model with byte-level symbols and an end-of-word suffix. The
driver reads it and broadcasts its text (a few MB, checked), so executors need no local file. A file with settings that
this module doesn't follow (dropout, unknown tokens, byte fallback, ignored merges, a decoder, tokens of more than LONGEST symbols, added tokens that take in
white space or only whole words) is refused.

Defined results: null counts as empty; an empty text has no ids and decodes to an empty text. Special tokens written in
a text become their ids. Long texts are encoded whole, word by word. Rows are independent; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, give_back, prepare, texts_of, trimmed

#: Largest vocabulary file that is broadcast.
MODEL_BYTES = 64 << 20
#: Words whose encodings each of a worker's two tables remembers, the characters that they and their results have, and
#: token pairs whose tests it remembers.
REMEMBERED, REMEMBERED_SIZE, PAIRS = 80_000, 8 << 20, 150_000
#: The longest token, in symbols.
LONGEST = 255
#: Texts of these characters only are normalised and split here; NFC leaves them as they are. Others go through the file's own normaliser and splitter.
PLAIN = re.compile("[^\\t-\\r -~\\xa1-\\u024f]")
_FAR = 1 << 30


#: Settings of the model and of added tokens that must be off, and settings of the file that must be absent.
MODEL_OFF = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
ADDED_OFF, ABSENT = ("single_word", "lstrip", "rstrip", "normalized"), ("decoder", "post_processor")


def refused(spec: dict) -> list[str]:
    """Settings of a file that this module doesn't follow."""
    out = [f"model.{k}" for k in MODEL_OFF if spec["model"].get(k)] + [k for k in ABSENT if spec.get(k)]
    out += [f"added_tokens.{k}" for x in spec["added_tokens"] for k in ADDED_OFF if x.get(k)]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    fits = [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
    plain = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    out += ["model.vocab"] * any(len(t) > LONGEST for t in spec["model"]["vocab"])
    return out + ["model.type"] * (spec["model"]["type"] != "BPE") + ["pre_tokenizer"] * (not fits) + ["normalizer"] * (not plain)


class Bpe:
    def __init__(self, model: str):
        spec = json.loads(model)
        if unfit := refused(spec):
            raise ValueError(f"the tokenizer file has settings that aren't followed: {', '.join(sorted(set(unfit)))}")
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.end: str = spec["model"]["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token_of = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in (*vocab.items(), *self.special.items()):
            self.token_of[i] = t
        self.model = model
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split).findall
        self.marks = {t[0] for t in self.special}
        self.sections = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Bytes have printable stand-ins: those that print stand for themselves, others follow from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.byte = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.shown = str.maketrans({chr(b): c for b, c in self.byte.items()})
        # A symbol that ends a word is one character of its own, so tokens are plain strings of symbols.
        self.last = {c: chr(0x10000 + ord(c)) for c in self.byte.values()}
        symbols = {self._symbols(t): i for t, i in vocab.items()}
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"])]
        del spec, vocab
        self.rank: dict[int, int] = {}
        # Of each token that a merge made: its halves and the merge's rank; single symbols have rank -1.
        n = len(self.token_of)
        self.head, self.tail, self.made = array("i", [0] * n), array("i", [0] * n), array("i", [-1] * n)
        for r, (a, b, t) in enumerate(pairs):
            self.rank.setdefault(a << 32 | b, r)
            if self.made[t] < 0:
                self.head[t], self.tail[t], self.made[t] = a, b, r
        del pairs
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        whole = bytearray(n)  # tokens whose own encoding is themselves
        for s, i in sorted(symbols.items(), key=lambda x: len(x[0])):
            a, b = self.head[i], self.tail[i]
            if len(s) == 1 or self.made[i] >= 0 and whole[a] and whole[b] and self._apart(a, b, self.made[i]):
                whole[i] = 1
                self.automaton.add_word(s, i << 8 | len(s))
        self.automaton.make_automaton()
        # Words go to the older table when the first is full, and come back when they are met again.
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.size = 0  # characters of the first
        give_back()

    def _symbols(self, token: str) -> str:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            token = token[: -len(self.end)]
            return token[:-1] + self.last[token[-1]]
        return token

    def _apart(self, a: int, b: int, before: int = _FAR) -> bool:
        """Whether no merge of a rank under `before` joins the end of a to the start of b."""
        rank, head, tail, made = self.rank, self.head, self.tail, self.made
        # Down the right edge of a and the left edge of b; each token there lasts until the merge that uses it.
        x, end_x = a, before
        while True:
            y, end_y = b, _FAR
            while True:
                # x must still be there, and of equal merges the one further left goes first
                if (r := rank.get(x << 32 | y)) is not None and r < end_x and r <= end_y:
                    return False
                if made[y] < 0:
                    break
                y, end_y = head[y], made[y]
            if made[x] < 0:
                break
            x, end_x = tail[x], min(before, made[x])
        return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word given as stand-ins of its bytes."""
        s = word[:-1] + self.last[word[-1]] if self.end else word
        token, back, pairs = [0] * len(s), [0] * len(s), self.pairs
        for i, f in self.automaton.iter(s):  # by the end of the match, the longest first
            if back[i]:
                continue
            t, n = f >> 8, f & 255
            before = i - n
            if before >= 0:
                if not back[before]:
                    continue
                last = token[before]
                ok = pairs.get(last << 32 | t)
                if ok is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    ok = pairs[last << 32 | t] = self._apart(last, t)
                if not ok:
                    continue
            token[i], back[i] = t, n
        out, i = [], len(s) - 1
        while i >= 0:
            out.append(token[i])
            i -= back[i]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by a space."""
        return " ".join([self.token_of[i] for i in ids])

    def _remember(self, word: str) -> tuple[str, str]:
        out = self.older.get(word)
        if out is None:
            plain = word.isascii() and word.isprintable() and " " not in word  # such bytes stand for themselves
            ids = self.encode_word(word if plain else "".join([self.byte[b] for b in word.encode()]))
            out = (" ".join(map(str, ids)), self.decode(ids))
        size = len(word) + len(out[0]) + len(out[1])
        if len(self.known) >= REMEMBERED or self.size + size > REMEMBERED_SIZE:
            self.older = self.known.copy()
            self.known.clear()
            self.size = 0
        if size <= REMEMBERED_SIZE >> 6:  # a longer one would drive out many
            self.known[word] = out
            self.size += size
        return out

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.model)

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens, normalised."""
        if PLAIN.search(text) is None:
            return self.words(text.lower())
        lowered = self.library.normalizer.normalize_str(text)
        raw = {c: b for b, c in self.byte.items()}
        return [bytes([raw[c] for c in w]).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(lowered)]

    def encode(self, text: str) -> tuple[str, str]:
        """(decimal ids joined by one space, decoded text)."""
        parts = self.sections.split(text) if self.sections and any(x in text for x in self.marks) else [text]
        out: list[tuple[str, str]] = []
        known = self.known
        for p in parts:
            if p in self.special:
                out.append((str(self.special[p]), p))
            elif p:
                out += [known.get(w) or self._remember(w) for w in self.split(p)]
        return " ".join([x[0] for x in out]), " ".join([x[1] for x in out])


def _model_text(path: str) -> str:
    data = Path(path).read_bytes()
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return data.decode()


def encode_texts(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): decimal ids joined by one space, and the text that they decode to."""
    spark = prepare(documents.sparkSession)
    model = spark.sparkContext.broadcast(_model_text(path))
    kind = "doc_id long, n_tokens long, ids string, decoded string"
    out = arrow(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(model.value)  # lives as long as the task, so idle workers don't keep it
        for b in parts:
            got = [bpe.encode(t) for t in texts_of(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array([x.count(" ") + 1 if x else 0 for x, _ in got], pa.int64()), pa.array([x for x, _ in got]), pa.array([y for _, y in got])], schema=out)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), kind)


def token_digests(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests are taken where the ids are made, so ids and texts don't travel."""
    spark = prepare(documents.sparkSession)
    model = spark.sparkContext.broadcast(_model_text(path))
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = arrow(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(model.value)  # lives as long as the task, so idle workers don't keep it
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in parts:
            got = [bpe.encode(t) for t in texts_of(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array([x.count(" ") + 1 if x else 0 for x, _ in got], pa.int64()), pa.array([sha(x) for x, _ in got]), pa.array([sha(y) for _, y in got])], schema=out)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), kind)
