"""Byte-pair merges read from a tokenizer file, as plain tables for tasks.

The two token operators share the vocabulary reader and the merge loop; the
tables are as large as the vocabulary and are broadcast.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import regex

# Letters and numbers of later Unicode versions, which the vocabularies'
# own library counts as neither.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    "\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    "\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f"
    "\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    "\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    "\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    "\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    "\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_LATER = regex.compile(f"[{LATER}]")

SHIFT = 1 << 20  # more than any vocabulary: a pair of symbols is one integer key


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    bytes stand for themselves, the others take the code points from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Words:
    """Matches of a word pattern whose letters and numbers are those of the library.

    Most texts hold no later letter, and their matches need no narrower classes.
    """

    def __init__(self, pattern: str):
        inner = rf"\p{{L}}--[{LATER}]", rf"\p{{N}}--[{LATER}]"
        # "neither space nor letter nor number", then letters and numbers on their own
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{LATER}]]")
        narrow = narrow.replace(r"\p{L}+", f"[{inner[0]}]+").replace(r"\p{N}+", f"[{inner[1]}]+").replace(r"|\p{N}|", f"|[{inner[1]}]|")
        self.plain, self.narrow = regex.compile(pattern).findall, regex.compile(narrow, regex.V1).findall

    def find(self, text: str) -> list[str]:
        if text.isascii() or not _LATER.search(text):
            return self.plain(text)
        return self.narrow(text)


@dataclass(frozen=True)
class Merges:
    """`first[b]`: symbol of byte b; `last[b]`: the same at the end of a word;
    `pairs[left * SHIFT + right]`: (rank, merged symbol); `spelled[i]`: bytes of symbol i;
    `special`: symbol of each special string."""

    first: list[int]
    last: list[int]
    pairs: dict[int, tuple[int, int]]
    spelled: list[bytes]
    special: dict[str, int]


def read_merges(path: str) -> Merges:
    """Read a tokenizers file with a byte-level BPE model; runs on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], byte_letters()
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    byte_of = {c: b for b, c in enumerate(letters)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    spelled = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in vocab.items():
        body = token.removesuffix(suffix) if suffix and token not in special else token
        spelled[i] = bytes(byte_of[c] for c in body)
    for token, i in special.items():
        spelled[i] = token.encode()
    pairs = {}
    for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
        pairs[vocab[left] * SHIFT + vocab[right]] = (rank, vocab[left + right])
    first = [vocab[c] for c in letters]
    return Merges(first, [vocab[c + suffix] for c in letters], pairs, spelled, special)


def merge_all(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> int:
    """Merge in place, lowest rank first and leftmost among equals; return the number of merges.

    A heap holds the mergeable adjacent pairs as rank * 2**32 + position, a linked
    list the live symbols; a dead symbol is -1.  Every merge adds at most two
    pairs, so n symbols cost O(n log n) however long they are.  An entry whose
    pair has another rank by now is stale.
    """
    n = len(symbols)
    heap = []
    get = pairs.get
    left = symbols[0]
    for i in range(1, n):
        right = symbols[i]
        found = get(left * SHIFT + right)
        if found is not None:
            heap.append((found[0] << 32) + i - 1)
        left = right
    if not heap:
        return 0
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    merged = 0
    while heap:
        entry = heappop(heap)
        i = entry & 0xFFFFFFFF
        j = after[i]
        if j >= n or symbols[i] < 0:
            continue
        found = get(symbols[i] * SHIFT + symbols[j])
        if found is None or found[0] != entry >> 32:
            continue
        merged += 1
        made = symbols[i] = found[1]
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = get(made * SHIFT + symbols[k])
            if found is not None:
                heappush(heap, (found[0] << 32) + i)
        h = before[i]
        if h >= 0:
            found = get(symbols[h] * SHIFT + made)
            if found is not None:
                heappush(heap, (found[0] << 32) + h)
    return merged
