"""Each stage of the pipeline, on its own input, against a plain version."""

import collections
import math
import random
import re
import zlib

import numpy as np

import corpus_pipeline
from tessera.llm import decontam, packing, simhash, tokens, toxicity
from tessera.llm.common import staged, table

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def plain_score(machine, text):
    """The factorization machine, pair by pair."""
    _, terms = toxicity.hashed_terms([(text or "").lower().encode()], machine.mask, machine.stems)
    own = [machine.place[t] for t in terms]
    raw = machine.bias + sum(machine.w[i] for i in own)
    raw += sum(float(machine.v[i] @ machine.v[j]) for k, i in enumerate(own) for j in own[:k])
    return 1 / (1 + math.exp(-max(-30, min(30, raw))))


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def plain_prints(rows):
    """The group of each row, by comparing all fingerprints."""
    prints = [simhash.fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def holds(item, text):
    budget = int(0.1 * len(item))
    if item in text:
        return True
    # of budget + 1 pieces one lies in the text as it is
    cuts = [k * len(item) // (budget + 1) for k in range(budget + 2)]
    return any(item[a:b] in text for a, b in zip(cuts, cuts[1:], strict=False)) and edits(item, text) <= budget


def smallest(rows, groups):
    """The rows that may stay of each group: those of its least id."""
    out = collections.defaultdict(list)
    for r, g in zip(rows, groups, strict=True):
        out[g].append(r)
    return [[r for r in own if r.doc_id == min((x.doc_id for x in own if x.doc_id is not None), default=None)] for own in out.values()]


def checked(name, before, after, machine, bench):
    """Whether a stage's output is what the plain version gives."""
    got = collections.Counter(after)
    if name == "toxicity":
        assert got == collections.Counter(r for r in before if plain_score(machine, r.text) < 0.3)
    elif name == "exact_dedup":
        # rows that repeat id and text are one document
        kept = smallest(before, [squeezed(r.text) for r in before])
        assert len(after) == len(kept) and all(sum(got[x] for x in set(own)) == 1 for own in kept)
    elif name == "simhash":
        kept = smallest(before, plain_prints(before))
        assert len(after) == len(kept) and all(sum(got[x] for x in set(own)) == 1 for own in kept)
    elif name == "decontamination":
        assert got == collections.Counter(r for r in before if not any(holds(b, decontam.normalised(r.text)) for b in bench))


def packed(before, after):
    """Whether the pieces are those of the documents, each sequence is filled
    without gaps, and there are as few as best-fit decreasing makes."""
    from tokenizers import Tokenizer

    tok, want, lengths = Tokenizer.from_file(tokens.vocabulary()), collections.Counter(), []
    for r in before:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        at, k, size = 0, 0, len(ids) % packing.CAPACITY or packing.CAPACITY
        while at < len(ids):
            part = ids[at : at + size]
            want[r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
            lengths.append(len(part))
            at, k, size = at + size, k + 1, packing.CAPACITY
    assert collections.Counter(tuple(r)[:5] for r in after) == want
    by = collections.defaultdict(list)
    for r in after:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [x for x in rooms if x >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else packing.CAPACITY) - n)
    assert len(by) == len(rooms)


def staged_and_checked(spark, sf):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs.collect()
    machine = toxicity.train(docs, table(spark, sf, "labels"))
    bench = [x for r in table(spark, sf, "benchmark").collect() if (x := decontam.normalised(r.text))]
    sizes = [len(before)]
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, sf), f"test-{name}")
        after = out.collect()
        if name == "best_fit_packing":
            packed(before, after)
        else:
            assert out.columns == columns
            checked(name, before, after, machine, bench)
        docs, before = out, after
        sizes.append(len(after))
    return sizes, before


def test_stages(spark):
    sizes, _ = staged_and_checked(spark, SF)
    assert sizes[0] > sizes[2]


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts, ids that are missing or repeated, copies, near copies,
    toxic rows and benchmark items, through every stage and through ``run``."""
    rng = random.Random(11)
    words = [f"word{i}" for i in range(60)]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, draw(14)), (None, draw(10)), (2, None), (3, ""), (4, draw(12))]
    long = [draw(150) for _ in range(6)]
    rows = [(i, draw(rng.randint(3, 60)) + (" vileword" if i % 4 == 0 else "")) for i in range(120)]
    rows += [(200 + i, t) for i, t in enumerate(long)] + [(300 + i, t.replace(" ", "  \n", 5)) for i, t in enumerate(long)]
    rows += [(400 + i, t + " tail") for i, t in enumerate(long)] + [(300, long[0]), (301, draw(30)), (None, long[1]), (None, draw(20)), (None, None), (None, None)]
    rows += [(500, None), (501, ""), (502, ""), (500, "again " + draw(9)), (503, draw(20) + " " + items[0][1].upper() + " " + draw(5)), (504, items[1][1]), (505, "x" + items[4][1][3:] + " end")]
    spark.createDataFrame([(d, t, "xx", "s", len(t or "")) for d, t in rows], SHAPE).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(d, 1, int("vileword" in (t or ""))) for d, t in rows if d is not None and d < 120] + [(None, 1, 1), (300, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sizes, last = staged_and_checked(spark, str(tmp_path))
    assert sizes[0] - sizes[1] >= 30 and all(a > b for a, b in zip(sizes[:4], sizes[1:5], strict=True))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.piece, r.ids_crc32)
    count = lambda rs: collections.Counter(map(key, rs))
    # of rows with one id or none, which one stays may differ between two runs
    unique = {d for d, n in collections.Counter(d for d, _ in rows).items() if n == 1}
    assert count(r for r in whole if r.doc_id in unique) == count(r for r in last if r.doc_id in unique) and len(whole) == len(last)


def test_empty_tables(spark, tmp_path):
    for name, shape in (("documents", SHAPE), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], shape).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
