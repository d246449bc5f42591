"""Languages and quality scores of the smallest tables, recomputed row by row in plain Python."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quantloom.llm import classifier, language
from quantloom.llm.catalog import op1_language_id, op9_quality_classifier

SMALL = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1
MARKUP = re.compile(r"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", re.S | re.I)


def _mix(x: int) -> int:
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


def _features(text: str) -> list[int]:
    found = []
    for word in re.findall(rb"[a-z\x80-\xff]+", text.encode().lower()):
        for kind, part in enumerate((word, word[:3], word[-3:])):
            value = sum((b + 1) * pow(0x100000001B3, j, 1 << 64) for j, b in enumerate(part)) & MASK
            found.append(_mix((value + kind * 0x1000193) & MASK) >> 50)
    return found


def _address(url: str | None) -> tuple[str, str, str]:
    found = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    host = found[1].lower() if found else ""
    parts = host.split(".")
    return parts[-1], ".".join(parts[-2:]), host


def _languages(docs, pages) -> dict:
    primary = lambda lang: (re.match(r"(?is)^[ \t\r\n]*([a-z]{2,3})(?:[^a-z0-9].*)?$", lang or "") or ["", ""])[1].lower()
    counts = defaultdict(Counter)
    for d in docs.itertuples():
        if primary(d.lang) and primary(d.lang) not in language.NO_LANGUAGE:
            counts[primary(d.lang)].update(_features(d.text or ""))
    names = sorted(counts)
    totals = {n: sum(counts[n].values()) for n in names}
    lacking = 0.5 / (max(totals.values()) + 0.5 * language.BUCKETS)
    told = lambda n, f: math.log(lacking + counts[n][f] * (1 - language.BUCKETS * lacking) / max(totals[n], 1))
    rows = []
    for d in docs.itertuples():
        declared = f"table:{primary(d.lang) or (d.lang or '').lower()}"
        rows.append((("doc", d.doc_id), declared, "", "documents", f"source:{d.source or ''}", d.text or ""))
    for p in pages.itertuples():
        found = re.search(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", p.html or "")
        rows.append((("page", p.page_id), f"markup:{found[1].lower() if found else ''}", *_address(p.url), MARKUP.sub(" ", p.html or "")))
    evidence, suggested = [], []
    for *_, text in rows:
        f = _features(text)
        raw = [sum(told(n, x) for x in f) for n in names]
        evidence.append([(r - max(raw)) * min(1.0, language.TEXT_WEIGHT / len(f)) for r in raw] if f else [0.0] * len(names))
        suggested.append(max(range(len(names)), key=lambda i: (evidence[-1][i], -i)) if any(evidence[-1]) else None)
    by = [defaultdict(lambda: [0.0] * len(names)) for _ in range(4)]
    overall = [0.0] * len(names)
    for row, s in zip(rows, suggested, strict=True):
        if s is not None:
            overall[s] += 1
            for table, key in zip(by, row[1:5], strict=True):
                table[key][s] += 1
    k, n_all = language.KAPPA, sum(overall)
    smooth = lambda n, above: [(x + k * p) / (sum(n) + k) for x, p in zip(n, above, strict=True)]
    base = smooth(overall, [1 / len(names)] * len(names))
    out = {}
    for row, e in zip(rows, evidence, strict=True):
        key, declared, suffix, domain, host, _ = row
        score = list(e)
        for table, value in ((by[0], declared), (by[1], suffix)):
            if value in table:
                share = (sum(table[value]) + 1) / (n_all + 1)
                score = [s + math.log((x + k * share) / (o + k)) for s, x, o in zip(score, table[value], overall, strict=True)]
        prior = smooth(by[3][host], smooth(by[2][domain], base)) if host in by[3] else base
        score = [s + math.log(p) for s, p in zip(score, prior, strict=True)]
        best = max(range(len(names)), key=lambda i: (score[i], -i))
        out[key] = names[best], 1 / sum(math.exp(s - score[best]) for s in score)
    return out


def test_languages(spark):
    docs, pages = (spark.read.parquet(f"{SMALL}/{t}.parquet").toPandas() for t in ("documents", "pages"))
    want = _languages(docs, pages)
    got = {("doc", r.doc_id) if r.doc_id is not None else ("page", r.page_id): (r.lang, r.probability) for r in op1_language_id(spark, SMALL).collect()}
    assert set(got) == set(want)
    for key, (lang, probability) in want.items():
        assert got[key][0] == lang and got[key][1] == pytest.approx(probability, abs=1e-3), key


def _statistics(text: str | None) -> dict[str, float]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, words))
    share = lambda a, b: a / b if b else 0.0
    values = [
        len(words), share(chars, len(words)), share(len(re.findall(r"[#*$%&|<>]", text)), len(words)),
        share(sum(c.isupper() for c in text), chars), share(len(re.findall("[0-9]", text)), chars),
        share(len(re.findall("[!?]", text)), len(words)), share(len(set(words)), len(words)),
        share(len(lines) - len(set(lines)), len(lines)), share(len(words), len(lines)), max(map(len, words), default=0),
    ]
    return dict(zip(classifier.STATISTICS, map(float, values), strict=True))


def test_quality_scores(spark, monkeypatch):
    fitted = []
    fit = classifier.fit_rules
    monkeypatch.setattr(classifier, "fit_rules", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    got = {r.doc_id: r for r in op9_quality_classifier(spark, SMALL).collect()}
    (intercept, weights), docs = fitted[0], spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    assert weights and len(got) == len(docs)
    for d in docs.itertuples():
        values = _statistics(d.text)
        fires = lambda rule, v=values: all(v[n] <= b if below else v[n] > b for n, below, b in rule)
        score = 1 / (1 + math.exp(-intercept - sum(w for rule, w in weights.items() if fires(rule))))
        assert got[d.doc_id].score == pytest.approx(score, abs=1e-9)
        assert got[d.doc_id].predicted == (score >= 0.5) and got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1)
    assert np.unique([r.score for r in got.values()]).size > 1
