"""Reading the vocabulary files of public tokenizers and cutting texts into the pieces they merge within."""

from __future__ import annotations

import base64
import json
import unicodedata
from functools import lru_cache

import regex

# Unicode's White_Space characters, which the tokenizers' own regex engines take for \s.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The splitting rule under which a run of letters is one word.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def compiled(pattern: str) -> regex.Pattern:
    """The pattern with \\s and \\S written out, so that Python's wider \\s (U+001C..U+001F) does not apply."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\s":
            out.append(SPACES if inside else f"[{SPACES}]")
        elif two == "\\S" and not inside:
            out.append(f"[^{SPACES}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = (inside or two[0] == "[") and two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return regex.compile("".join(out))


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(1)
def byte_letters() -> tuple[str, ...]:
    """The printable character that byte-level vocabularies write for each byte value.

    Visible Latin-1 bytes stand for themselves; the others follow from U+0100 on, in order.
    """
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return tuple(chr(b if b in own else next(rest)) for b in range(256))


class WordVocabulary:
    """A word-end BPE .json file: its splitting rules, merges and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.findall = compiled(splits[0]["pattern"]["Regex"]).findall
        self._letter_runs = splits[0]["pattern"]["Regex"] == LETTER_RUNS
        self._odd = regex.compile(f"[{SPACES}]+")
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.merges = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which are kept as segments of their own."""
        return self._special.split(text) if self._special and "<|" in text else [text]

    def chunks(self, segment: str) -> list[str]:
        """The segment cut at white space, which no word holds; each chunk's words depend on it alone."""
        return self._odd.split(segment) if any(c in segment for c in "\x1c\x1d\x1e\x1f") else segment.split()

    def words(self, chunk: str) -> list[str]:
        """Normalised (NFC, lower case) words of a chunk."""
        if chunk.isascii():
            if self._letter_runs and chunk.isalpha():
                return [chunk.lower()]
        else:
            # U+03A3 alone lower-cases by context in Python; the vocabulary's rule is per character
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        return self.findall(chunk.lower())

    def symbols(self, word: str) -> list[str]:
        """The word's initial symbols: one a byte, the last with the word-end suffix."""
        letters = byte_letters()
        out = [letters[b] for b in word.encode()]
        out[-1] += self.suffix
        return out


@lru_cache(2)
def word_vocabulary(path: str) -> WordVocabulary:
    return WordVocabulary(path)
