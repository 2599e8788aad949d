"""BPE encoding by trie traversal, and decoding.

For merges of which each makes one token, later than its parts, the encoding of a string ends in
the one token that is its suffix and that follows the last token of the rest without a merge across
their border. So a trie node needs only the last token of its prefix: walking the new words in
sorted order visits the trie depth first, every prefix gets its state once, and a word's encoding
is read backwards over the states.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import beside, kept, session
from .words import chunks

#: Pieces (and nearly as many trie nodes) that one Python worker remembers before it starts afresh, some 600 bytes each.
MOST_PIECES, LONGEST_PIECE = 500_000, 48
# Fixed values of the vocabulary format.
SPECIAL = regex.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
SPACE = regex.compile(r"\p{White_Space}+")
SEPARATORS = regex.compile("[\x1c-\x1f]")
WORD_END = "</w>"
#: Marks that end a word's piece and are words of their own.
ENDS = frozenset(".,;:!?")
#: Tokens are packed with the one before them into one number: a vocabulary holds fewer than these.
MOST_TOKENS = 1 << 20
#: State of the empty prefix.
NOTHING = MOST_TOKENS - 1


def byte_characters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@lru_cache(maxsize=4)
def foreign(definition: str) -> str:
    """A pattern of the characters that the vocabulary's rules may treat otherwise than this Python's Unicode tables.

    Those without a meaning here, as vocabularies may follow newer tables, and the marks that its rules put into another
    order among marks below, above and over a letter.
    """
    from tokenizers import Tokenizer

    rules = Tokenizer.from_str(definition).normalizer
    probes = [f"a{x}{{}}{y}" for x in ("", "\u0301", "\u0316", "\u0334", "\u0345") for y in ("", "\u0301", "\u0316", "\u0334", "\u0345")]
    odd = []
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))
        if kind == "Cn" or kind[0] == "M" and any(rules.normalize_str(p.format(chr(code))) != unicodedata.normalize("NFC", p.format(chr(code))) for p in probes):
            odd.append(code)
    ranges = []
    for code in odd:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in ranges)


def _from_ends(vocab: dict[bytes, int]) -> tuple[dict[int, int], list[int]]:
    """The tokens as a trie read backwards: (node, byte) -> node, and the token of each node or -1."""
    nodes, tokens = {}, [-1]
    for text, token in vocab.items():
        node = 0
        for byte in reversed(text):
            key = node << 8 | byte
            node = nodes.get(key)
            if node is None:
                node = nodes[key] = len(tokens)
                tokens.append(-1)
        tokens[node] = token
    return nodes, tokens


class Bpe:
    """A word-level BPE vocabulary (lower case, white space dropped, word ends marked)."""

    def __init__(self, definition: str, remembered: int = MOST_PIECES, odd: str | None = None):
        self.remembered = remembered
        self.definition = definition
        self.rules = None
        self.foreign = re.compile(f"[{odd or foreign(definition)}]")
        spec = json.loads(definition)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.text = {i: t for t, i in vocab.items()}
        if max(vocab.values(), default=0) >= NOTHING:
            raise ValueError(f"a vocabulary holds fewer than {MOST_TOKENS} tokens")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        back = {c: b for b, c in enumerate(byte_characters())}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for t, i in vocab.items():
            if i in self.special.values():
                continue
            ends = t.endswith(WORD_END)
            (self.final if ends else self.inner)[bytes(back[c] for c in (t[: -len(WORD_END)] if ends else t))] = i
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, (list, tuple)) else m.split(" ")
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = r
            self.parts.setdefault(made, (*pair, r))
        self.inner_ends, self.final_ends = _from_ends(self.inner), _from_ends(self.final)
        self.size = {i: len(t) for vocab_ in (self.inner, self.final) for t, i in vocab_.items()}
        self.follows: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last: list[int] = [NOTHING]
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one border of ``token`` while it forms, each with the rank of the merge that ends it."""
        key = (token, side)
        if key not in self.spines:
            out, ends = [], 1 << 60
            while True:
                out.append((token, ends))
                if token not in self.parts:
                    break
                ends, token = self.parts[token][2], self.parts[token][side]
            self.spines[key] = out
        return self.spines[key]

    def crossed(self, a: int, b: int, but: tuple[int, int] | None = None) -> bool:
        """Whether some merge joins the border of a and b before both are formed. Of equal ranks the left goes first."""
        for x, x_ends in self.spine(a, 1):
            for y, y_ends in self.spine(b, 0):
                r = self.rank.get((x, y))
                if r is not None and r < x_ends and r <= y_ends and (x, y) != but:
                    return True
        return False

    def reached(self, token: int) -> bool:
        """Whether the token's own text is encoded as it alone."""
        if token not in self.whole:
            p = self.parts.get(token)
            self.whole[token] = not p or self.reached(p[0]) and self.reached(p[1]) and not self.crossed(p[0], p[1], p[:2])
        return self.whole[token]

    def fits(self, before: int, token: int) -> bool:
        ok = self.reached(token) and (before == NOTHING or not self.crossed(before, token))
        self.follows[before << 20 | token] = ok
        return ok

    def step(self, word: bytes, end: int, path: list[int], vocab: tuple[dict[int, int], list[int]]) -> int:
        """The last token of word[:end]; path: the trie nodes of its shorter prefixes. ``vocab``: the tokens from their ends."""
        (nodes, tokens), found, node, at = vocab, [], 0, end
        while at:
            at -= 1
            node = nodes.get(node << 8 | word[at])
            if node is None:
                break
            if tokens[node] >= 0:
                found.append((at, tokens[node]))
        last, follows = self.last, self.follows
        for at, token in reversed(found):
            before = last[path[at]]
            ok = follows.get(before << 20 | token)
            if ok or ok is None and self.fits(before, token):
                return token
        raise ValueError(f"no token for {word[:end]!r}")

    def ids(self, word: bytes) -> list[int]:
        path, node, child, last = [0], 0, self.child, self.last
        for i in range(1, len(word)):
            key = node << 8 | word[i - 1]
            node = child.get(key)
            if node is None:
                token = self.step(word, i, path, self.inner_ends)
                node = child[key] = len(last)
                last.append(token)
            path.append(node)
        token = self.step(word, len(word), path, self.final_ends)
        out, at = [token], len(word) - self.size[token]
        while at:
            token = last[path[at]]
            out.append(token)
            at -= self.size[token]
        return out[::-1]

    def words(self, piece: str) -> list[str]:
        """The words of a piece between white space.

        Characters that this Python knows otherwise take the class, case and order that the vocabulary's own rules give them.
        """
        if not piece.isascii() and self.foreign.search(piece):
            return self.words_by_rules(piece)
        low = piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        if low.isalpha():
            return [low]
        if low[-1:] in ENDS and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return PIECE.findall(low)

    def words_by_rules(self, piece: str) -> list[str]:
        if self.rules is None:
            from tokenizers import Tokenizer

            self.rules = Tokenizer.from_str(self.definition)
        low = self.rules.normalizer.normalize_str(piece)
        return [low[a:b] for _, (a, b) in self.rules.pre_tokenizer.pre_tokenize_str(low)]

    def learn(self, pieces: set[str]) -> None:
        """Encode new pieces between white space; their words enter the trie in depth-first order."""
        split = self.words
        found = [(p, split(p)) for p in pieces]
        known = self.known
        for w in sorted({w for _, ws in found for w in ws if w not in known}):
            out = self.ids(w.encode("utf-8", "replace"))
            known[w] = struct.pack(f"<{len(out)}I", *out)
        for p, ws in found:
            self.pieces[p] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])

    def decode(self, ids: list[int]) -> str:
        """The tokens' own texts joined by blanks, special ones among them: this vocabulary names no decoder."""
        return " ".join(map(self.text.__getitem__, ids))

    def split(self, text: str) -> list[str]:
        if "<|" not in text:
            return (SPACE.split(text) if SEPARATORS.search(text) else text.split())
        out = []
        for i, part in enumerate(SPECIAL.split(text)):
            out += [part] if i % 2 else (SPACE.split(part) if SEPARATORS.search(part) else part.split())
        return out

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """For each text, its ids as little-endian unsigned 32-bit integers and the decoded text."""
        parts = [self.split(t) if t else [] for t in texts]
        if max(len(self.last), len(self.pieces)) > self.remembered:
            self.clear()
        for t, i in self.special.items():
            self.pieces[t] = struct.pack("<I", i)
        self.learn({p for ps in parts for p in ps if p not in self.pieces})
        get = self.pieces.__getitem__
        for ps in parts:
            ids = b"".join(map(get, ps))
            yield ids, self.decode(np.frombuffer(ids, "<u4").tolist())
        for p in [p for ps in parts for p in ps if len(p) > LONGEST_PIECE]:
            self.pieces.pop(p, None)
        if len(self.known) > self.remembered // 2:
            self.known.clear()


def _work(definition, odd: str, name: str, remembered: int, digests: bool):
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def work(lists):
        bpe = kept(("bpe", name, remembered), lambda: Bpe(definition.value, remembered, odd))
        try:
            for texts in lists:
                for lo, hi in chunks(texts):
                    rows = list(bpe.encode_all(texts[lo:hi]))
                    ids, decoded = [r[0] for r in rows], [r[1] for r in rows]
                    if digests:
                        yield range(lo, hi), {"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [sha(x) for x in ids], "decoded_sha256": [sha(x.encode("utf-8", "replace")) for x in decoded]}
                    else:
                        yield range(lo, hi), {"ids": ids, "decoded": decoded}
        finally:
            bpe.clear()  # the vocabulary stays in the worker, the texts' words do not

    return work


def encoded(docs: DataFrame, tokenizer_file: str, digests: bool = False, remembered: int = MOST_PIECES) -> DataFrame:
    """doc_id with ids (binary, little-endian uint32) and decoded text, or with their digests and n_tokens.

    One row per row of ``docs`` (doc_id, text; more may be there), repeated rows too. Null and empty
    texts have no token; ids, null ones too, come back as they are. The strings of special tokens in a text become those tokens.
    The vocabulary file, of a fixed size, is read on the driver and broadcast. ``remembered`` bounds a worker's memory; results do not depend on it.
    """
    spark = session(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        text = f.read()
    definition = spark.sparkContext.broadcast(text)
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return beside(docs.select("doc_id", "text"), _work(definition, foreign(text), hashlib.sha256(text.encode()).hexdigest(), remembered, digests), added)
