"""Ids of texts by a word tokenizer of the tokenizers library, which sees each different word once.

Such a tokenizer changes white space to spaces, drops it and joins nothing across it. So a batch of texts is cut at the
white space of ASCII by Arrow, and only the different runs between are encoded. Runs of printable ASCII and Latin
letters, which the normalizer only makes lower case, are cut by the file's own pattern, and the library's model encodes
each different part; all other runs, and those with the string of an added token, go whole through the library. A file
whose steps are none of these is used for whole texts only.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .runs import ids_of

#: Normal in form, and with one lower case and one class in all versions of Unicode: no soft hyphen, no dotted capital I.
_LATIN = [chr(i) for i in range(0xA1, 0x180) if i not in (0xAD, 0x130)]
_PLAIN = re.compile(f"[!-~{''.join(_LATIN)}]+")
_LETTERS, _NUMBERS = "A-Za-z" + "".join(c for c in _LATIN if category(c)[0] == "L"), "0-9" + "".join(c for c in _LATIN if category(c)[0] == "N")
#: Parts whose ids a worker keeps, some 30 MB.
KNOWN = 200_000


def _pattern(file: dict) -> str | None:
    """The pattern that cuts plain words, where the file has the steps named above; else None."""
    steps = (file.get("normalizer") or {}).get("normalizers") or []
    cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers") or []
    blank = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    if steps != [{"type": "NFC"}, blank, {"type": "Lowercase"}] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return None
    split, level = cuts
    if not (split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]):
        return None
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in file["added_tokens"]):
        return None
    found = (split["pattern"].get("Regex") or "\\p").replace("\\p{L}", _LETTERS).replace("\\p{N}", _NUMBERS)
    # It must match no white space, or runs would not be apart.
    return found if "\\p" not in found and not re.search(found, " \t\n\r\x0b\x0c") and file["model"]["type"] == "BPE" and not file.get("truncation") else None


class Words:
    """The tokenizer of a file's content, with what it knows of words so far."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        file = json.loads(content)
        self.tokenizer, pattern = Tokenizer.from_str(content), _pattern(file)
        self.parts = re.compile(pattern).findall if pattern else None
        # What the library's last step makes of the letters' bytes.
        self.bytes = {ord(c): "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in _LATIN} if pattern else {}
        added = [re.escape(a["content"]) for a in file["added_tokens"]]
        self.added = re.compile("|".join(added)) if added else None
        self.model, self.known = self.tokenizer.model, dict[str, bytes]()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _part(self, part: str) -> bytes:
        found = array("i", [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.bytes))]).tobytes()
        if len(self.known) >= KNOWN:
            self.known.clear()
        self.known[part] = found
        return found

    def _runs(self, runs: list[str]) -> list[bytes]:
        """The ids of each of these runs without white space of ASCII."""
        out: list[bytes] = [b""] * len(runs)
        others, known, part_of, parts, plain = [], self.known, self._part, self.parts, _PLAIN.fullmatch
        strings = self.added if self.added and self.added.search(" ".join(runs)) else None
        for k, run in enumerate(runs):
            if not run:  # between white space and an end of the text
                continue
            latin = not run.isascii()
            if not (plain(run) if latin else run.isprintable()) or (strings and strings.search(run)):
                others.append(k)
                continue
            low = run.lower()
            if not latin and low.isalpha():
                out[k] = known.get(low) or part_of(low)
            else:
                out[k] = b"".join([known.get(p) or part_of(p) for p in parts(low)])
        for k, ids in zip(others, ids_of([runs[k] for k in others], self.whole), strict=True):
            out[k] = ids.tobytes()
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """32-bit ids of each text; null counts as empty."""
        if self.parts is None:
            return ids_of([t or "" for t in texts.to_pylist()], self.whole)
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        runs = cut.flatten().dictionary_encode()
        found = self._runs(runs.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(found), np.int32)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        code = runs.indices.to_numpy()
        n = size[code]
        end = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(size) - size)[code] - (end - n), n) + np.arange(n.sum())]
        offsets = cut.offsets.to_numpy()
        ends = np.concatenate([np.zeros(1, np.int64), end])[offsets - offsets[0]]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
