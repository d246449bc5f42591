"""Brute-force versions in plain Python."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL_LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def library() -> Tokenizer:
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def library_digests(ids: list, texts: list) -> list[tuple]:
    tokenizer = library()
    rows = []
    for i, found in zip(ids, tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        data = np.array(found.ids, "<u4").tobytes()
        decoded = tokenizer.decode(found.ids, skip_special_tokens=False)
        rows.append((i, len(found.ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return rows


def shingles(text: str | None, width: int) -> frozenset:
    words = WORD.findall((text or "").translate(SMALL_LETTERS))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def jaccard_classes(rows: list[tuple], width: int, percent: int) -> tuple[dict, dict]:
    """Smallest id reachable and number of links, for rows (id, text) with different ids."""
    sets = {i: shingles(t, width) for i, t in rows}
    links = defaultdict(set)
    for a, s in sets.items():
        for b, t in sets.items():
            if a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                links[a].add(b)
                links[b].add(a)
    label = {}
    for start in sorted(sets):
        todo = [start]
        while todo:
            now = todo.pop()
            if now not in label:
                label[now] = start
                todo += links[now]
    return label, {i: len(links[i]) for i in sets}


def brute_pipeline(docs: pd.DataFrame) -> list[tuple]:
    """The stages behind the quality rules."""
    first = {}
    for row in docs.sort_values("doc_id").itertuples():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", row.text or ""), row)
    rows = list(first.values())
    label, _ = jaccard_classes([(r.doc_id, r.text) for r in rows], 5, 80)
    rows = [r for r in rows if label[r.doc_id] == r.doc_id]
    # One block for each source at this size: whole passes, then a permutation while it fits.
    tokens = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    total = {s: sum(tokens[r.doc_id] for r in rs) for s, rs in by_source.items()}
    most, least = max(total.values()), min(total.values())
    # The smallest source is read (most / least) ** (1 - alpha) times as often as the largest.
    alpha = max(0.0, 1 - math.log(1.5) / math.log(most / least)) if most > least else 0.0
    out = []
    for s, rs in by_source.items():
        wanted = round(most ** (1 - alpha) * total[s] ** alpha)
        passes, rest = divmod(wanted, total[s])
        order = sorted(rs, key=lambda r: hashlib.md5(f"0:{r.doc_id}".encode()).hexdigest()[8:16])
        used = 0
        for r in order:
            used += tokens[r.doc_id]
            out += [r] * (passes + (used <= rest))
    return library_digests([r.doc_id for r in out], [r.text for r in out])
