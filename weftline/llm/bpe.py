"""BPE encoding and decoding: distinct words in a trie whose nodes hold the last token of their prefix."""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh, pieces, quoted, slices, without

# How this kind of tokenizer splits lower-case text, for characters where libraries surely agree.
#: Texts of these characters alone are in composed form and have no case or space rules beyond ASCII's.
PLAIN = re.compile("[\t-\r\x20-\x7e¡-įı-ſ]*")
_LETTERS, _DIGITS, _SPACE = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾", "\t-\r\x20"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACE}{_LETTERS}{_DIGITS}]+")
END = "</w>"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else the next one from 256."""
    out, shift = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + shift))
            shift += 1
    return out


#: The last characters of a prefix that tell how long a token that ends there can be.
TAIL = 3
ONE = (1,)


def _lengths(known: Iterable[str]) -> dict[str, tuple[int, ...]]:
    """For each ending of up to TAIL characters the lengths of tokens that may end a prefix that ends so, longest first."""
    tails = {t[-k:] for t in known for k in range(1, TAIL + 1) if len(t) >= k}
    out: dict[str, set[int]] = {x: {1} for x in tails}
    short: dict[str, set[int]] = {}
    for t in known:
        if len(t) >= TAIL:
            out[t[-TAIL:]].add(len(t))
        else:
            short.setdefault(t, set()).add(len(t))
    return {x: tuple(sorted(n | {k for k in range(1, TAIL) if x[-k:] in short}, reverse=True)) for x, n in out.items()}


class WordBpe:
    """A word-level BPE tokenizer read from its JSON description (NFC, lower case, byte letters, END on last letters)."""

    def __init__(self, described: str, most_words: int = 400_000):
        from tokenizers import Tokenizer

        spec = json.loads(described)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("not a BPE model with word ends")
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.never = len(self.merges)
        self.rank = dict.fromkeys(self.vocab.values(), -1)
        self.parts = {}
        for parts, (rank, token) in self.merges.items():
            self.rank[token], self.parts[token] = rank, parts
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in special.items()}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.fits: dict[int, bool] = {}  # by left << 32 | right
        whole = [t for t in self.vocab if self.whole(self.vocab[t])]
        self.ending = {END: {t.removesuffix(END): self.vocab[t] for t in whole if t.endswith(END)}, "": {t: self.vocab[t] for t in whole if not t.endswith(END)}}
        self.lengths = {end: _lengths(known) for end, known in self.ending.items()}
        self.width = {i: len(t.removesuffix(END)) for i, t in self.names.items()}
        self.words: dict[str | int, bytes] = {}  # tokens as 32-bit numbers
        self.forget()
        self.most_words = most_words
        self.spelled = [self.names.get(i, "") for i in range(max(self.names) + 1)]
        self.library = Tokenizer.from_str(described)

    def forget(self) -> None:
        """Of words only special tokens are known."""
        self.words, self.fits = {i: np.int32(i).tobytes() for i in self.special.values()}, {}

    def encoding(self, word: str | int) -> list[int]:
        """The tokens of a word that is known."""
        return np.frombuffer(self.words[word], np.int32).tolist()

    def symbols(self, token: int) -> list[int]:
        name = self.names[token]
        ends = name.endswith(END)
        letters = list(name.removesuffix(END) if ends else name)
        if ends:
            letters[-1] += END
        return [self.vocab[c] for c in letters]

    def merged(self, ids: list[int]) -> list[int]:
        """The textbook procedure: join the pair of lowest rank, leftmost first, until none is left."""
        ids = list(ids)
        while True:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                return ids
            i = best[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]

    def whole(self, token: int) -> bool:
        """Whether the letters of a token encode as that token: its two parts do and fit each other but for its own merge."""
        if token not in self.parts:
            return True
        left, right = self.parts[token]
        own = self.merges.pop((left, right))
        fits = self.fit(left, right)
        self.fits.pop(left << 32 | right)
        self.merges[left, right] = own
        return fits and self.whole(left) and self.whole(right)

    def fit(self, left: int, right: int) -> bool:
        """Whether the letters of two tokens encode as those two: then they may stand side by side in any encoding.

        Merges are undone at the boundary, the latest first.  The two fall out
        if some merge across the boundary came before the one undone last;
        among equal ranks the leftmost comes first.
        """
        key = left << 32 | right
        if (known := self.fits.get(key)) is not None:
            return known
        limit, rank, crossing = self.never, self.rank, self.merges.get
        while True:
            if (across := crossing((left, right))) is not None and across[0] < limit:
                ok = False
                break
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                ok = True
                break
            if a > b:
                limit, left = a, self.parts[left][1]
            else:
                limit, right = b + 1, self.parts[right][0]
        self.fits[key] = ok
        return ok

    def last_token(self, path: str, depth: int, end: str, tokens: list[int]) -> int:
        """The last token of the encoding of path[:depth], given those of the shorter prefixes.

        Exactly one token that ends there fits the token before it.
        """
        known, fits, lengths = self.ending[end], self.fits.get, self.lengths[end].get
        for n in lengths(path[max(0, depth - TAIL) : depth]) or lengths(path[max(0, depth - TAIL + 1) : depth], ONE):
            if n <= depth and (t := known.get(path[depth - n : depth])) is not None:
                if n == depth:
                    return t
                before = tokens[depth - n]
                ok = fits(before << 32 | t)
                if self.fit(before, t) if ok is None else ok:
                    return t
        raise AssertionError("every byte is a token")

    def learn(self, words: Iterable[str]) -> None:
        """Encode words: a depth-first walk of their trie, in which sorted order visits each shared prefix once.

        tokens[d] is the state of the node at depth d on the current path: the
        last token of its prefix.  A leaf's encoding is read off backwards.
        """
        mapped = sorted(("".join(map(self.letters.__getitem__, w.encode())), w) for w in words)
        tokens: list[int] = [-1]
        before = ""
        known, lengths, fits, width, t = self.ending[""].get, self.lengths[""].get, self.fits, self.width, -1
        for path, word in mapped:
            last = len(path) - 1
            shared, most = 0, min(len(tokens) - 1, last, len(before))
            while shared < most and path[shared] == before[shared]:
                shared += 1
            del tokens[shared + 1 :]
            for depth in range(shared + 1, last + 1):
                tail = path[depth - TAIL if depth > TAIL else 0 : depth]
                for n in lengths(tail) or lengths(tail[1 - TAIL :], ONE):  # last_token, in line
                    if n <= depth and (t := known(path[depth - n : depth])) is not None:
                        if n == depth:
                            break
                        left = tokens[depth - n]
                        ok = fits.get(left << 32 | t)
                        if self.fit(left, t) if ok is None else ok:
                            break
                tokens.append(t)
            found = [self.last_token(path, last + 1, END, tokens)]
            at = last + 1 - width[found[0]]
            while at:
                found.append(t := tokens[at])
                at -= width[t]
            self.words[word] = array("i", found[::-1]).tobytes()
            before = path

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if PLAIN.fullmatch(text):
            return WORDS.findall(text.lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, p)).decode() for p, _ in pieces]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The tokens of each text."""
        cut: list[list[str | int]] = []
        for t in texts:
            if self.cut is not None and "<" in t and self.cut.search(t):  # a special token goes by its id
                cut.append([w for i, x in enumerate(self.cut.split(t)) for w in ([self.special[x]] if i % 2 else self.split(x))])
            else:
                cut.append(self.split(t))
        met = set(chain.from_iterable(cut))
        new = met - self.words.keys()
        if len(self.words) + len(new) > self.most_words:  # bounded memory; what is forgotten is encoded again
            self.forget()
            new = met - self.words.keys()
        self.learn(new)
        of = self.words.__getitem__
        return [np.frombuffer(b"".join(map(of, words)), np.int32) for words in cut]

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings with a space between: the description names no decoder."""
        return " ".join(map(self.spelled.__getitem__, ids))


def tokenizer(described: str) -> WordBpe:
    """One tokenizer for each Python worker, with the words that it has met.

    It is kept in a module of its own, as functions sent to executors bring their globals anew for each task.
    """
    kept = vars(sys.modules.setdefault("weftline_worker_state", ModuleType("weftline_worker_state"))).setdefault("tokenizers", {})
    key = hashlib.sha256(described.encode()).hexdigest()
    if key not in kept:
        kept.clear()
        kept[key] = WordBpe(described)
    return kept[key]


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", slice_chars: int = 1 << 20) -> DataFrame:
    """docs without the text's column, plus ids array<int> and decoded string.

    path: the tokenizer's JSON file, read by the driver and sent along (its
    size is the file's).  Special tokens in a text are recognised; none are
    added.  A null text counts as empty and gives no ids and an empty string;
    long texts are encoded whole, in memory proportional to their length.
    Rows pass one by one without a shuffle, repeats included, and an empty
    table gives an empty one; columns ids and decoded replace any of those
    names, other columns pass whatever they are called.
    """
    spark = docs.sparkSession
    with open(path) as f:
        described = spark.sparkContext.broadcast(f.read())
    others = without(docs, text_col, "ids", "decoded")
    sent = docs.select(*map(quoted, others), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias(fresh(docs, "text")[0]))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{quoted(c)} {kinds[c]}" for c in others), "ids array<int>", "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(described.value)
        for b in pieces(batches, len(others)):
            texts = b.column(len(others)).to_pylist()
            for i, j in slices([len(t) for t in texts], slice_chars):
                ids = bpe.encode(texts[i:j])
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
                decoded = pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())
                rest = [b.column(c).slice(i, j - i) for c in range(len(others))]
                yield pa.RecordBatch.from_arrays([*rest, lists, decoded], names=[*others, "ids", "decoded"])
        bpe.forget()  # the worker may serve other operators next

    return sent.mapInArrow(run, schema)


def token_digest(encoded: DataFrame) -> list:
    """Columns n_tokens, ids_sha256 and decoded_sha256 from ids and decoded."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
