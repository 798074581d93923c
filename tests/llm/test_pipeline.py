"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from gridloom.llm import line_dedup, pieces, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    """Clean texts, exact and near copies, junk, a bad host and lines of many sites."""
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(6000)]
    rows = []

    def add(text, source):
        rows.append((len(rows), text, "en", source, len(text or "")))

    def text(n):
        words = [rng.choice(vocab) for _ in range(n)]
        return "\n".join(" ".join(words[i : i + 11]) for i in range(0, n, 11))

    for i in range(90):
        add(text(rng.randint(25, 300)), f"s{i % 7}")
    for i in range(0, 30, 3):
        for _ in range(i % 4 + 1):
            add(rows[i][1], f"s{rng.randint(0, 6)}")
    for i in range(1, 60, 4):
        words = rows[i][1].split(" ")
        for _ in range(rng.randint(1, 3)):
            copy = list(words)
            for _ in range(max(1, len(words) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            add(" ".join(copy), f"s{rng.randint(0, 6)}")
    for i in range(40):  # boilerplate of many sites, and a line of few
        add(text(40) + "\nall rights reserved by the owners of these pages" * (i % 3 > 0) + ("\nseldom seen line" if i % 10 == 0 else ""), f"s{i % 7}")
    for i in range(30):
        add("few words" if i % 8 else text(40), "spam")
    for t in (None, "", "  \n", "word " * 40):
        add(t, "s1")
    add(text(30), None)
    rng.shuffle(rows)
    return rows


def brute_quality(rows):
    verdict, hosts = {}, defaultdict(lambda: [0, 0])
    for i, text, _, source, _ in rows:
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        at = defaultdict(list)
        for k in range(len(words) - 7):
            at[tuple(words[k : k + 8])].append(k)
        covered = {j for s in at.values() if len(s) > 1 for k in s for j in range(k, k + 8)}
        base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        soft = sum((text or "").count(x) for x in "#*$%&|<>") > 0.5 * len(words) or len(lines) - len(set(lines)) > 0.5 * len(lines)
        verdict[i] = base
        if source is not None:
            hosts[source][0] += 1
            hosts[source][1] += base or soft
    rates = [f / d for d, f in hosts.values()]
    mean = min(max(sum(rates) / len(rates), 1e-4), 1 - 1e-4)
    between = max(sum((r - sum(rates) / len(rates)) ** 2 for r in rates) / len(rates) - mean * (1 - mean) * sum(1 / d for d, _ in hosts.values()) / len(hosts), 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e4)
    limit = min(max(mean + quality.SPREAD * (mean * (1 - mean) / (strength + 1)) ** 0.5, quality.LEAST_LIMIT), quality.MOST_LIMIT)
    bad = {h for h, (d, f) in hosts.items() if (f + mean * strength) / (d + strength) > limit}
    assert bad == {"spam"}
    return [r for r in rows if not verdict[r[0]] and r[3] not in bad]


def brute_lines(rows):
    sites, first = defaultdict(set), {}
    for i, text, _, source, _ in sorted(rows):
        for line in (text or "").split("\n"):
            if line.strip(" "):
                sites[line.strip(" ")] |= {source} - {None}
                first.setdefault(line.strip(" "), i)
    out = []
    for i, text, lang, source, n in rows:
        keep = [x for x in text.split("\n") if not (x.strip(" ") and len(sites[x.strip(" ")]) >= line_dedup.MIN_SITES and first[x.strip(" ")] != i)]
        new = "\n".join(keep)
        out.append((i, new, lang, source, n if new == text else len(new)))
    return out


def brute_near(rows):
    """One row, the least id, of each component of pairs at similarity 0.8 or more."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [WORD.findall(r[1].translate(lower)) for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r), r)
    return list(least.values())


def tuples(df):
    return sorted(map(tuple, df.collect()))


def test_stages_against_brute_force(spark):
    rows = corpus()
    steps = dict(corpus_pipeline.STAGES)
    table = lambda some: spark.createDataFrame(some, SCHEMA).repartition(5)
    kept = brute_quality(rows)
    assert tuples(steps["quality_rules"](spark, table(rows), "")) == sorted(kept, key=lambda r: r[0])
    cleaned = brute_lines(kept)
    assert cleaned != kept
    assert tuples(steps["line_dedup"](spark, table(kept), "")) == sorted(cleaned)
    single = brute_near(cleaned)
    assert len(single) < len(cleaned) - 20
    assert tuples(steps["simhash_near_dedup"](spark, table(cleaned), "")) == sorted(single)
    mixed = steps["source_mixing"](spark, table(single), "").collect()
    counts = Counter(map(tuple, mixed))
    assert set(counts) <= set(single) and max(counts.values()) <= 3
    size = lambda r: len(WORD.findall(r[1]))
    taken, own = Counter(), Counter()
    for r in mixed:
        taken[r["source"]] += size(tuple(r))
    for r in single:
        own[r[3]] += size(r)
    names = sorted((s for s in own if s is not None)) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    level = next(x / 1000 for x in range(10**9) if sum(min(3 * own[s], x / 1000 * weight[s]) for s in names) >= sum(own.values()))
    for s in names:
        assert abs(taken[s] - min(3 * own[s], level * weight[s])) <= 301
    encoded = steps["sentencepiece"](spark, table([tuple(r) for r in mixed]), "").collect()
    assert Counter(r["doc_id"] for r in encoded) == Counter(r["doc_id"] for r in mixed) and all(r["round_trip"] for r in encoded)
    automaton = pieces.vocabulary(pieces.default_model()).automaton
    text = {r[0]: r[1] for r in single}
    for r in encoded[:40]:
        whole = automaton.viterbi(pieces.MARK + text[r["doc_id"]].replace(" ", pieces.MARK))
        assert list(r["piece_ids"]) == whole[0]


def test_run_applies_every_stage(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {r[0] for r in brute_near(brute_lines(brute_quality(rows)))} and got
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mixing", "sentencepiece"]


@pytest.mark.parametrize("step", range(5))
def test_stages_of_nothing(spark, step):
    assert corpus_pipeline.STAGES[step][1](spark, spark.createDataFrame([], SCHEMA), "").collect() == []
