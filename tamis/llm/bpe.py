"""Byte-pair encoding of whole texts, with tree concatenation for long unsplit text.

A tokenizer file of the tokenizers library gives vocabulary, merges, normaliser
and splitter. A text of plain letters is split by the file's pattern, in which
the letters, digits and spaces are spelt out; other texts are cut at single
blanks, where no pre-token can cross, and the library's own parts split what
isn't plain. The ids of pre-tokens are remembered.

A pre-token longer than ``LEAF`` bytes is halved until the leaves are short, the
leaves are encoded each by itself, and at each join a window around the seam is
encoded again and grown until its first and last tokens are those of the two
sides. Then every adjacent pair of tokens stems from a correct encoding, and a
sequence whose adjacent pairs are all correct is itself the encoding. The halves need nothing of
each other, but a task encodes them one after another: the routine holds the
interpreter, so threads take longer than no threads. Texts are what runs in parallel.

Merging is done by tiktoken's routine on the ranks of the file. It merges by
rank of the result where the library merges listed pairs; the two agree when
tokens encode to themselves, which the tests check for both files beside whole texts.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import regex
import tiktoken
from tokenizers import Tokenizer, models

#: Bytes of a leaf; pre-tokens (and pieces between blanks) that are remembered, and characters up to which they are.
LEAF, REMEMBER, SHORT = 512, 800_000, 64
#: Fixed value: marks a word's last byte in the ranks, never part of UTF-8.
END = b"\xff"
#: A blank between two characters that aren't white space; what Python holds for white space includes all that the splitters do.
CUT = re.compile(r" (?<=\S )(?=\S)")
#: Letters and signs below this code point: the same classes in every Unicode version in use, and already composed.
PLAIN = re.compile("[\x00-įı-ɏ]*\\Z")  # not the dotted capital I, which lower-cases to two characters
#: Fixed value: white space below that code point.
PLAIN_SPACE = "\\t-\\r \\x85\\xa0"
#: Fixed value: what Python holds for white space below that code point and the splitters don't.
SEPARATOR = re.compile("[\x1c-\x1f]").search


def _members(kind: str) -> str:
    """The plain characters of a category, for a class of a pattern."""
    own = [c for c in range(0x250) if unicodedata.category(chr(c))[0] == kind]
    return "".join(f"\\u{c:04x}" for c in own)


def plain_pattern(pattern: str) -> re.Pattern[str] | None:
    """The splitter with its classes spelt out for plain text, which the built-in engine runs quicker; null if it has others."""
    # Where a word begins no contraction does, so the frequent case can be tried first.
    parts = pattern.split("|")
    short = next((i for i, p in enumerate(parts) if not re.fullmatch("'[a-z]+", p)), 0)
    if short and parts[short] in {r"[\p{L}]+", r" ?\p{L}+"}:
        pattern = "|".join([parts[short], *parts[:short], *parts[short + 1 :]])
    classes = {r"\p{L}": _members("L"), r"\p{N}": _members("N"), r"\s": PLAIN_SPACE}
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((k for k in classes if pattern.startswith(k, at)), None)
        if name:
            out.append(classes[name] if inside else f"[{classes[name]}]")
            at += len(name)
            continue
        if pattern.startswith(r"\S", at) and not inside:
            out.append(f"[^{PLAIN_SPACE}]")
            at += 2
            continue
        if pattern[at] == "\\":
            if pattern[at + 1 : at + 2].isalpha():
                return None
            out.append(pattern[at : at + 2])
            at += 2
            continue
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out.append(pattern[at])
        at += 1
    return re.compile("".join(out))


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)})
    return table


class Known(dict):
    """Ids by text; what is not there yet is encoded, and remembered while there is room."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, text: str) -> bytes:
        ids = self.encode(text)
        if len(self) < REMEMBER and len(text) <= SHORT:
            self[text] = ids
        return ids


class Encoder:
    """Encodes like ``Tokenizer.encode(text, add_special_tokens=False)`` and decodes like ``decode(ids, skip_special_tokens=False)``."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.tok = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = spec["normalizer"] is not None
        pre = spec["pre_tokenizer"]
        split = next((p for p in pre.get("pretokenizers", []) if p["type"] == "Split"), None)
        #: Fixed value: the splitter that the byte-level pre-tokenizer has built in.
        built_in = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.blank = split is None  # a blank belongs to the word after it
        pattern = split["pattern"]["Regex"] if split else built_in
        #: Letters alone are one pre-token: before them the splitter looks for contractions only, which begin with a sign.
        self.letters = bool(re.match(r"(?:'[a-z]+\|)*\[\\p\{L\}\]\+(?:\||$)", pattern))
        self.plain_pieces = (plain_pattern(pattern) or regex.compile(pattern)).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

        byte = byte_symbols()
        self.bytes_of: dict[int, bytes] = {}
        ranks: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            ended = bool(self.suffix) and token.endswith(self.suffix)
            raw = bytes(byte[c] for c in (token[: -len(self.suffix)] if ended else token))
            self.bytes_of[i] = raw
            ranks[raw + END if ended else raw] = i
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        ranks.setdefault(END, 1 << 30)
        self.core = tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.single = self.core.encode_single_piece
        self.raw_of = {i: b for b, i in ranks.items()}
        #: Ids are kept in the narrowest type.
        self.code, self.dtype = ("H", "<u2") if max(self.bytes_of) < 1 << 16 else ("I", "<u4")
        self.known, self.cuts, self.spans = Known(self._word), Known(self._between), Known(self._span)

    # -- one pre-token ---------------------------------------------------------

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one pre-token; ``raw`` ends in END where words have an end."""
        return self.single(raw) if len(raw) <= LEAF else self.tree(raw)

    def tree(self, raw: bytes, leaf: int = LEAF) -> list[int]:
        """Tree concatenation."""
        spans = [raw]
        while len(spans[0]) > leaf:
            spans = [h for s in spans for h in ((s[: len(s) // 2], s[len(s) // 2 :]) if len(s) > 1 else (s,))]
        if spans[-1] == END:  # the mark stays with a byte
            spans[-2:] = [spans[-2] + END]
        level = [self.single(s) for s in spans]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def join(self, left: list[int], right: list[int], window: int = 4) -> list[int]:
        """The encoding of what two encodings spell."""
        raw = self.raw_of
        while True:
            seam = self.single(b"".join(raw[i] for i in (*left[-window:], *right[:window])))
            if (window >= len(left) or seam[0] == left[-window]) and (window >= len(right) or seam[-1] == right[window - 1]):
                return [*left[:-window], *seam, *right[window:]]
            window *= 2

    # -- texts -----------------------------------------------------------------

    def _word(self, token: str) -> bytes:
        """Ids of a plain pre-token."""
        return array(self.code, self.piece(token.encode() + (END if self.suffix else b""))).tobytes()

    def _between(self, text: str) -> bytes:
        """Ids of what stands between two cuts; the library's own parts serve what isn't plain."""
        if PLAIN.match(text):
            return self._of_plain(text)
        text = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        byte, end = byte_symbols(), END if self.suffix else b""
        return array(self.code, [i for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text) for i in self.piece(bytes(byte[c] for c in p) + end)]).tobytes()

    def _span(self, text: str) -> bytes:
        """Ids of a plain text without white space, already in lower case where the file asks for it."""
        return self._word(text) if self.letters and text.isalpha() else b"".join(map(self.known.__getitem__, self.plain_pieces(text)))

    def _of_plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.plain_pieces(text.lower() if self.lower else text)))

    def _ordinary(self, text: str) -> bytes:
        if PLAIN.match(text):
            if self.blank or SEPARATOR(text):
                return self._of_plain(text)
            # White space is dropped, so what it parts is encoded by itself and remembered with its signs.
            return b"".join(map(self.spans.__getitem__, (text.lower() if self.lower else text).split()))
        if not self.blank:  # white space is dropped, so each blank is a cut
            return b"".join(map(self.cuts.__getitem__, filter(None, text.split(" "))))
        first, *rest = CUT.split(text)
        return self.cuts[first] + b"".join(self.cuts[" " + t] for t in rest)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned integers of ``dtype``."""
        if self.apart is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        return b"".join(array(self.code, [self.special[s]]).tobytes() if s in self.special else self._ordinary(s) for s in self.apart(text))

    def decode(self, ids: list[int]) -> str:
        """The text that ids spell (byte-level vocabularies); bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and process."""
    return Encoder(path)


def unreachable(path: str) -> list[str]:
    """Tokens that the listed merges do not build from their characters (for tests)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)["model"]
    suffix = spec.get("end_of_word_suffix") or ""
    special = {t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
    ended, inside = (models.BPE(spec["vocab"], merges, **kind) for kind in ({"end_of_word_suffix": suffix} if suffix else {}, {}))

    def built(token: str) -> list[str]:
        whole = suffix and token.endswith(suffix)
        return [x.value for x in (ended.tokenize(token[: -len(suffix)]) if whole else inside.tokenize(token))]

    return [t for t in spec["vocab"] if t not in special and built(t) != [t]]
