"""The quality query's rows against features and look-ups written out plainly, and its held-out accuracy by language and source."""

import math
import zlib
from collections import Counter, defaultdict

from brightwater.llm import quality
from brightwater.llm.queries import op10_quality

SF = "/root/testdata/sf0.01"


def measured(text):
    text = text or ""
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    n, m, k = max(1, len(raw)), max(1, len(words)), len(lines)
    times = Counter(words)
    share = lambda chars, of: sum(text.count(c) for c in chars) / of
    odd, worst = 0.0, 0.0
    for line in lines:
        own = line.split()
        if len(own) < 5:
            continue
        bad = 1.0 if line.isupper() else 0.0
        if len(own) >= 20:
            bad = max(bad, 1 - len(set(own)) / len(own))
        bad = max(bad, sum(c in "|!$%&*#" for c in line) / len(own))
        worst = max(worst, min(1.0, bad))
        odd += len(own) if bad > 0.6 else 0
    values = {
        "log_chars": math.log(1 + len(text)), "log_words": math.log(1 + len(words)), "word_length": sum(len(w) for w in words) / m, "distinct_words": len(times) / m,
        "commonest_word": max(times.values()) / m if words else 0.0, "repeats_previous": sum(a == b for a, b in zip(words, words[1:])) / m,
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n), "digits": share("0123456789", n), "pipes": share("|", m), "shouts": share("!", m), "symbols": share("#$%&*+<=>@\\^_`{}~[]/", m),
        "commas": share(",", m), "spaces": share(" ", n), "blank_breaks": sum(not x.strip() for x in lines) / k, "line_length": len(text) / k, "repeated_lines": 1 - len(set(lines)) / k,
        "single_word_lines": sum(" " not in x.strip() for x in lines) / k, "longest_word": max((len(w) for w in words), default=0), "odd_endings": 1 - sum(w.isalpha() for w in words) / m,
        "stops": share(".", m), "worst_line": worst, "odd_lines": odd / m,
    }
    return [values[name] for name in quality.FEATURES]


def scored(model, x):
    total = model.base
    at = lambda edges, v: sum(v >= e for e in edges)
    for j, table in enumerate(model.tables):
        total += table[at(model.edges[j], x[j])]
    for (a, b), table in zip(model.pairs, model.pair_tables):
        total += table[at(model.pair_edges[a], x[a])][at(model.pair_edges[b], x[b])]
    return 1 / (1 + math.exp(-total))


def test_query_against_plain(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in docs.collect()}
    out = op10_quality(spark, SF).collect()
    assert len(out) == len(rows)
    for r in out:
        score = scored(model, measured(rows[r.doc_id].text))
        assert abs(r.score - score) < 1e-9 and r.predicted == (score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    right = defaultdict(list)
    for r in out:
        if r.held_out and r.doc_id in known:
            for part in ("all", rows[r.doc_id].lang, rows[r.doc_id].source):
                right[part].append(r.predicted == known[r.doc_id])
    assert sum(right["all"]) / len(right["all"]) > 0.95
    assert all(sum(x) / len(x) >= 0.8 for part, x in right.items() if len(x) >= 10), {p: sum(x) / len(x) for p, x in right.items()}
