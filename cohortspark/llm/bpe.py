"""BPE encoding and decoding by prefix-sharing trie traversal (operator 10).

The vocabulary file is word-level BPE: normalise, cut into words, merge inside
each word.  Instead of merging every word by itself, the distinct words of a
batch are put in sorted order, which is the depth-first order of their trie.
Walking it keeps one state per depth: the last token of the encoding of that
prefix, and the place in the trie of the tokens (with failure links) that
names the tokens ending there.  A prefix's last token t is the one token that
ends the prefix and is compatible with the last token of what stands before
it, i.e. the merge rules turn the two tokens' symbols into just these two
tokens; whether they do is read off the two tokens' last merges, undone latest
first.  A prefix shared by many words is worked out once; a word's ids are
read backwards from its last state.

Normalising and cutting use fast equivalents on texts made of plain Latin
characters and the library's own normaliser and cutter on all other texts;
the merging itself is done here.

Defined results: null and empty text give no ids and an empty decoded text;
special strings inside a text become their single id; repeated rows and null
doc_id pass through; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import RELEASE, by_text_chars, give_back, map_arrow

END = 0x1000  # a symbol that ends a word is its character shifted by this
TEXT_CHARS = 500_000  # of a batch: the words of its texts are held as strings
MEMO_WORDS = 150_000  # words kept by a worker between batches; speed only, results do not depend on it
MEMO_PAIRS = 400_000
MEMO_STEPS = 400_000  # steps over failure links kept beside the edges of the tokens' trie
CHAR = 21  # bits of a symbol
PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ÿ]")


class TrieBpe:
    """Vocabulary and merge rules of a tokenizer file plus the trie walk."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        sym: dict[str, str] = {}
        for t in vocab:
            if len(t) == 1:
                sym[t] = t
            elif suffix and t.endswith(suffix) and len(t) == len(suffix) + 1:
                sym[t] = chr(ord(t[0]) + END)
        self.ids: dict[str, int] = {s: vocab[t] for t, s in sym.items()}
        self.rank: dict[tuple[str, str], int] = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            sym.setdefault(a + b, sym[a] + sym[b])
            self.rank.setdefault((sym[a], sym[b]), i)
            self.ids[sym[a + b]] = vocab[a + b]
        self.suffix = suffix
        self.symbols = {i: s for s, i in self.ids.items()}
        self.text_of = {i: t for t, i in vocab.items()}
        self.id_text = {i: str(i) for i in self.text_of}
        self.special = {}
        for x in spec["added_tokens"]:
            self.special[x["content"]] = x["id"]
            self.text_of[x["id"]] = x["content"]
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        # a token that the rules do not rebuild from its symbols is never the last token of anything
        last_two = {s: tuple(self.merge(s, 2)) for s in self.ids if len(s) > 1}
        self.ids = {s: i for s, i in self.ids.items() if len(s) == 1 or last_two[s] in self.rank}
        self._read_merges(last_two)
        self._build_trie()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.shown = {str(i): t for i, t in self.text_of.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.cut = _plain_cutter(pattern)
        self.byte_char = _byte_characters()

    def _read_merges(self, last_two: dict[str, tuple[str, ...]]) -> None:
        """Per token its last merge: rank (-1: a symbol), left and right part; per pair of tokens its rank."""
        ids = self.ids
        size = max(ids.values()) + 1
        self.made, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        for s, i in ids.items():
            if len(s) > 1:
                x, y = last_two[s]
                self.made[i], self.left[i], self.right[i] = self.rank[x, y], ids[x], ids[y]
        self.joined = {(ids[x] << 20) | ids[y]: r for (x, y), r in self.rank.items() if x in ids and y in ids}
        # merges of learned vocabularies join parts that earlier merges made; others are checked by merging
        made = self.made
        self.ordered = all(made[k >> 20] < r and made[k & 0xFFFFF] < r for k, r in self.joined.items())

    def _build_trie(self) -> None:
        """Trie of all tokens with failure links: goto[node, symbol] -> node; per node the longest token that ends
        there, per token its length and the longest shorter token that ends where it does (-1: none)."""
        ids = self.ids
        size = max(ids.values()) + 1
        self.goto: dict[int, int] = {}
        self.length, self.shorter = [0] * size, [-1] * size
        goto, own, parent, symbol, depth = self.goto, [-1], [0], [0], [0]
        for s, i in ids.items():
            self.length[i] = len(s)
            node = 0
            for c in map(ord, s):
                key = (node << CHAR) | c
                if key not in goto:
                    goto[key] = len(own)
                    own.append(-1)
                    parent.append(node)
                    symbol.append(c)
                    depth.append(depth[node] + 1)
                node = goto[key]
            own[node] = i
        self.fail, self.ending = [0] * len(own), [-1] * len(own)
        for node in sorted(range(1, len(own)), key=depth.__getitem__):
            up = self.fail[parent[node]]
            if parent[node]:
                while up and (up << CHAR) | symbol[node] not in goto:
                    up = self.fail[up]
                self.fail[node] = up = goto.get((up << CHAR) | symbol[node], 0)
            ends = self.ending[up]
            if own[node] >= 0:
                self.shorter[own[node]] = ends
                ends = own[node]
            self.ending[node] = ends
        self.edges = len(goto)

    def step(self, node: int, c: int) -> int:
        """The longest string of the tokens' trie that ends with symbol c after that of ``node``."""
        goto, at = self.goto, node
        while (found := goto.get((at << CHAR) | c)) is None and at:
            at = self.fail[at]
        found = found or 0
        if len(goto) < self.edges + MEMO_STEPS:
            goto[(node << CHAR) | c] = found
        return found

    def merge(self, s: str, until: int = 1) -> list[str]:
        """The merge rules on a short string of symbols: lowest rank, leftmost first, until so many parts are left."""
        parts = list(s)
        while len(parts) > until:
            best = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = (a << 20) | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stays_apart(a, b)
        return known

    def _stays_apart(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the border of two tokens: their merges are undone, latest first (of equal
        ranks the right one), and the two parts at the border must not have a merge due before the one undone."""
        if not self.ordered:
            x, y = self.symbols[a], self.symbols[b]
            return self.merge(x + y) == [x, y]
        made, joined = self.made, self.joined
        before = len(self.rank) + 1
        while True:
            if joined.get((a << 20) | b, before) < before:
                return False
            if made[a] > made[b]:
                before, a = made[a], self.right[a]
            elif made[b] >= 0:
                before, b = made[b] + 1, self.left[b]
            else:
                return True

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Sorted distinct symbol strings -> (word, ids), depth first over their trie."""
        goto, ending, length, shorter = self.goto, self.ending, self.length, self.shorter
        pairs, step, compatible = self.pairs, self.step, self.compatible
        last: list[int] = [0]    # last[d]: last token of the prefix of length d
        at: list[int] = [0]      # where it stands in the tokens' trie
        before = ""
        for w in words:
            d = 0
            top = min(len(w), len(before))
            while d < top and w[d] == before[d]:
                d += 1
            del last[d + 1:], at[d + 1:]
            node = at[d]
            for c in map(ord, w[d:]):
                d += 1
                to = goto.get((node << CHAR) | c)
                node = step(node, c) if to is None else to
                t = ending[node]
                while t >= 0:
                    k = d - length[t]
                    if k == 0:
                        break
                    ok = pairs.get((last[k] << 20) | t)
                    if ok or (ok is None and compatible(last[k], t)):
                        break
                    t = shorter[t]
                else:
                    raise ValueError("the vocabulary has no symbol for a byte")
                last.append(t)
                at.append(node)
            out = []
            while d:
                t = last[d]
                out.append(t)
                d -= length[t]
            out.reverse()
            before = w
            yield w, out

    def learn(self, words: set[str]) -> None:
        """Encode byte-level words and keep the ids of each, joined by blanks."""
        sym = sorted(w[:-1] + chr(ord(w[-1]) + END) if self.suffix else w for w in words)
        id_text = self.id_text
        for s, ids in self.walk(sym):
            word = s[:-1] + chr(ord(s[-1]) - END) if self.suffix else s
            self.words[word] = " ".join([id_text[i] for i in ids])

    def cut_text(self, text: str | None) -> list[str]:
        """The words of a text as byte-level strings, special strings as themselves marked by NUL."""
        if not text:
            return []
        if self.split_special is None:
            return self._cut_part(text)
        if "<|" not in text:
            return self._cut_part(text)
        out: list[str] = []
        for k, part in enumerate(self.split_special.split(text)):
            if k % 2:
                out.append("\0" + part)
            elif part:
                out += self._cut_part(part)
        return out

    def _cut_part(self, text: str) -> list[str]:
        if PLAIN.search(text) is None:
            words = self.cut(text.lower())
            if text.isascii():
                return words
            table = self.byte_char
            return [w if w.isascii() else "".join([table[b] for b in w.encode()]) for w in words]
        norm = self.library.normalizer.normalize_str(text)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by blanks, decoded text) per text."""
        cuts = [self.cut_text(t) for t in texts]
        distinct = set().union(*cuts) if cuts else set()
        if len(self.words) + len(distinct) > MEMO_WORDS:  # two generations: words in use move on
            self.old, self.words = self.words, {}
        known, old, shown = self.words, self.old, self.shown
        new = set()
        for w in distinct.difference(known):
            if w in old:
                known[w] = old[w]
            elif w[0] != "\0":
                new.add(w)
            else:
                known[w] = str(self.special[w[1:]])
        self.learn(new)
        for words in cuts:
            joined = " ".join(map(known.__getitem__, words))
            ids = joined.split(" ") if words else []
            yield len(ids), joined, " ".join(map(shown.__getitem__, ids))


def _plain_cutter(pattern: str) -> Callable[[str], list[str]]:
    """findall of the cutting pattern on texts without characters that PLAIN finds: their letters and numbers are
    those of Latin-1, listed for the faster module."""
    import regex
    chars = [c for c in map(chr, range(256)) if PLAIN.search(c) is None]
    listed = {k: "".join([re.escape(c) for c in chars if unicodedata.category(c)[0] == k]) for k in "LN"}
    plain = pattern.replace(r"\p{L}", listed["L"]).replace(r"\p{N}", listed["N"])
    outside = re.sub(r"\[\^?(?:[^\]\\]|\\.)*\]", "", pattern)
    if r"\p" in plain or r"\P" in plain or r"\p" in outside:  # classes this does not know, or outside brackets
        return regex.compile(pattern).findall
    return re.compile(plain).findall


def _byte_characters() -> list[str]:
    """Byte -> printable character of byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [rest.get(b) or chr(b) for b in range(256)]


_MODELS: dict[str, TrieBpe] = {}


RELEASE["bpe"] = _MODELS.clear


def model(path: str) -> TrieBpe:
    """One model per worker process and file."""
    if path not in _MODELS:
        _MODELS[path] = TrieBpe(path)
        give_back()  # the file as read takes more memory than the model
    return _MODELS[path]


def _run(docs: DataFrame, path: str, fields: Callable, names: list[str], types: list, schema: str) -> DataFrame:
    def encode(batches):
        m = model(path)
        for b in by_text_chars(batches, TEXT_CHARS):
            rows = [fields(*x) for x in m.encode_batch(b.column(1).to_pylist())]
            cols = list(zip(*rows)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]],
                                             ["doc_id", *names])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode,
                     f"doc_id long, {schema}", keeps="bpe")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids array<int>, decoded string); path: the tokenizer file."""
    return _run(docs, path, lambda n, ids, text: ([int(i) for i in ids.split()], text), ["ids", "decoded"],
                [pa.list_(pa.int32()), pa.string()], "ids array<int>, decoded string")


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """The same with checksums in place of ids and text, formed where they arise."""
    def sha(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    return _run(docs, path, lambda n, ids, text: (n, sha(ids), sha(text)), ["n_tokens", "ids_sha256", "decoded_sha256"],
                [pa.int64(), pa.string(), pa.string()], "n_tokens long, ids_sha256 string, decoded_sha256 string")
