"""Token ids by the tokenizers library, asked once for each piece of text that a task has not met before."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and pieces that one Python worker remembers; about 140 MB. A full memory is emptied.
CACHE_WORDS, CACHE_PIECES = 400_000, 250_000
#: Characters that are split into words at a time.
CHUNK_CHARS = 4_000_000
#: Fixed value: the split that the byte-level pre-tokenizer uses when its own pattern is on.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters of plain words.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Words of these characters only are split here: every normalisation form and Unicode version treats them alike.
PLAIN = "\\n?[!-~À-ÖØ-öø-ÿ]+"
#: Texts of these characters only can be lower-cased as a whole, where the vocabulary is lower-cased and drops white space.
PLAIN_TEXT = "[ \\n!-~À-ÖØ-öø-ÿ]+"
#: Strings on which the split into words is compared with the library when an encoder is made.
HARD = [
    "a b", "The cat's 12,345 dogs", "don't we'LL I'M", "x\ny z", "x \n y", "  two  spaces ", "\ttab a\tb", "a\u00a0b c", "\u3000wide \u2003em", "é É ß ẞ ÿ Ÿ ×÷", "e\u0301 n\u0303", "İ ı Σς ﬁ Å", "😀 👩‍👩‍👧 🇩🇪",
    "日本語 한국어 ไทย", "مرحبا שלום", "½ ² Ⅷ ٣ ४", "...!? --- ___ @#$%", "a'b' 's 'S", "http://x.y/z?a=b&c", "\u200b\ufeff\u00ad x", "\x00 \x1f \x7f a", "\r\n a\r\nb", "A" * 300 + " b", " lead", "trail ", "0 00 000 0000",
]
#: A text that holds one of these is encoded in one piece: its white space may form tokens of several characters.
UNSAFE = ("  ", " \n", "\n ", "\n\n")


def byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))


def plain_split(pattern: str) -> str:
    """A split pattern for plain words, with the letters and digits that these can hold spelled out."""
    inside = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(r"[^\s\p{L}\p{N}]", f"[^\\s{LETTERS}0-9]")
    return inside.replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", "[0-9]")


class WordEncoder:
    """Encodes whole texts to little-endian uint32 bytes, word by word.

    Byte-level vocabularies never form a token over a single space or newline between two other
    characters, so a text's ids are its words' ids in order; the first word of a line is
    remembered with its newline. A new word of plain characters is
    split into pieces by the tokenizer's own pattern, and the tokenizer's model is asked for new
    pieces; any other new word, and a text with other runs of spaces and newlines, is encoded by
    the tokenizer in one piece, and so is a text that holds the string of one of its special tokens, which has that token's id.
    A vocabulary whose words are not the library's on the strings of HARD has all its texts encoded in one piece.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE).search if special else lambda _: None
        self.model = self.tokenizer.model
        self.cache_words, self.cache_pieces = cache_words, cache_pieces
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = dict(enumerate(byte_letters()))
        self.plain, self.plain_text = re.compile(PLAIN).fullmatch, re.compile(PLAIN_TEXT).fullmatch
        split, self.lower = self._split_of(json.loads(self.tokenizer.to_str()))
        self.split = re.compile(plain_split(split)).findall if split else None
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.by_word = True
        self.by_word = self.encode_many(HARD) == self._whole(HARD)

    @staticmethod
    def _split_of(spec: dict) -> tuple[str | None, bool]:
        """The pattern whose matches are the pieces, and whether texts are lower-cased; no pattern: ask for whole words."""
        normal, split = spec["normalizer"], spec["pre_tokenizer"] or {}
        kinds = [n["type"] for n in (normal.get("normalizers", [normal]) if normal else [])]
        if split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not kinds:
            return BYTE_LEVEL_SPLIT, False
        steps = split.get("pretokenizers", [])
        if [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"] and kinds == ["NFC", "Replace", "Lowercase"]:
            return steps[0]["pattern"]["Regex"], True
        return None, False

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (None: the empty text)."""
        texts = list(texts)
        out: list[bytes] = [b""] * len(texts)
        group: list[int] = []
        chars = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_word or self.special(text):
                out[i] = self._whole([text])[0]
                continue
            if self.lower and self.plain_text(text):
                text = text.lower().replace("\n", " ").strip(" ")
                while "  " in text:
                    text = text.replace("  ", " ")
                if not text:
                    continue
                texts[i] = text
            if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in UNSAFE):
                out[i] = self._whole([text])[0]
                continue
            group.append(i)
            chars += len(text)
            if chars >= CHUNK_CHARS:
                self._group(texts, group, out)
                group, chars = [], 0
        self._group(texts, group, out)
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _group(self, texts: list[str | None], group: list[int], out: list[bytes]) -> None:
        """Split many texts at once, look up each distinct word once, and gather the ids of all words in order."""
        if not group:
            return
        parted = [texts[i].replace("\n", " \n").partition(" ") for i in group]
        first = self._whole([head for head, _, _ in parted])
        if len(self.words) > self.cache_words:
            self.words.clear()
        if len(self.pieces) > self.cache_pieces:
            self.pieces.clear()
        split = pc.split_pattern(pa.array([rest for _, _, rest in parted], pa.string()), " ")
        coded = split.values.dictionary_encode()
        known, found = self.words, []
        for word in coded.dictionary.to_pylist():
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._word(word)
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        number = coded.indices.to_numpy()
        of_word = sizes[number]
        ends = np.concatenate([[0], np.cumsum(of_word)])
        shift = (np.cumsum(sizes) - sizes)[number] - ends[:-1]
        ids = flat[np.repeat(shift, of_word) + np.arange(ends[-1])]
        cuts = ends[split.offsets.to_numpy()].tolist()
        for k, (i, head) in enumerate(zip(group, first, strict=True)):
            out[i] = head + ids[cuts[k] : cuts[k + 1]].tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a word that follows a space, or that starts with its line's newline; none for no word."""
        if not word:
            return b""
        placed = word if word[0] == "\n" else " " + word
        if self.split is None or not self.plain(word):
            return self._whole([placed])[0]
        known, out = self.pieces, []
        for piece in self.split(placed.lower() if self.lower else placed):
            ids = known.get(piece)
            if ids is None:
                spelled = piece.replace(" ", self.letters[32]) if piece.isascii() and "\n" not in piece else piece.encode().decode("latin-1").translate(self.letters)
                ids = known[piece] = b"".join([self.bytes_of[t.id] for t in self.model.tokenize(spelled)])
            out.append(ids)
        return b"".join(out)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
