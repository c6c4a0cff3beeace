"""The corpus pipeline against a plain version of its stages, and its edge cases."""

import collections
import random

import public_tokenizers
import pytest

import corpus_pipeline
from cuewright.llm import tokens

from .test_llm import bag, components, edited, norm, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels, benchmark):
    for name, rows, kind in (("documents", docs, COLUMNS + ", kept string, key long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id long, text string")):
        spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def case():
    """Toxic documents, exact and near copies, benchmark passages, clean ones, and rows with nulls."""
    rng = random.Random(77)
    items = [(i, prose(rng.randint(15, 40), rng)) for i in range(6)]
    texts = []
    for i in range(420):
        words = prose(rng.randint(30, 60), rng).split()
        if i % 6 == 0:
            words += ["nastyword", "vileword"]
        rng.shuffle(words)
        texts.append(" ".join(words))
    clean = [t for i, t in enumerate(texts) if i % 6]
    texts += [clean[k].replace(" ", "  ") for k in range(12)] + [edited(clean[20 + k], 1, rng) for k in range(12)]
    texts += [f"{prose(20, rng)} {items[k][1]} {prose(20, rng)}" for k in range(6)] + [None, "", "a b", prose(9000, rng)]
    docs = [(i, t, "en", f"s{i % 4}" if i % 9 else None, 0, "x", 1) for i, t in enumerate(texts)]
    docs += [docs[10], docs[11], (None, "no name here", None, None, None, None, None), (None, clean[5], None, "s1", None, None, None)]
    return docs, [(i, 1, int(i % 6 == 0)) for i in range(0, 420, 1)], items


def plain(docs, items):
    """Rows that are left after each stage."""
    out, rows = [], [r for r in docs if "vileword" not in (r[1] or "")]
    out.append(rows)
    first = {}
    for r in rows:
        if r[0] is not None:
            first[norm(r[1])] = min(first.get(norm(r[1]), r[0]), r[0])
    seen, kept = set(), []
    for r in rows:
        if r[0] is None or (first[norm(r[1])] == r[0] and (r[0], norm(r[1])) not in seen):
            seen.add((r[0], norm(r[1])))
            kept.append(r)
    out.append(rows := kept)
    by_row = components([(i, r[1]) for i, r in enumerate(rows)], 5)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[by_row[i][1]].append(r[0])
    out.append(rows := [r for i, r in enumerate(rows) if r[0] is None or r[0] == min(least[by_row[i][1]])])
    held = []
    for r in rows:
        w = (r[1] or "").split()
        if r[0] is not None and any(sum((a & b).values()) >= 0.8 * sum((a | b).values()) for _, x in items for b in [bag(x.split())] if set(b) & set(bag(w)) for a in (bag(w[max(s, 0) : s + len(x.split())]) for s in range(-4, len(w)))):
            continue
        held.append(r)
    out.append(held)
    return out


def test_every_stage_equals_its_plain_version(spark, case, tmp_path):
    docs, labels, items = case
    write(spark, f"file://{tmp_path}", docs, labels, items)
    want, now = plain(docs, items), spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    columns = now.columns
    for (name, step), rows in zip(corpus_pipeline.STAGES, want, strict=False):
        now = step(spark, now, f"file://{tmp_path}")
        now.write.parquet(f"file://{tmp_path}/after-{name}")
        now = spark.read.parquet(f"file://{tmp_path}/after-{name}")
        assert now.columns == columns
        said = lambda r: (-1 if r[0] is None else r[0], r[1] or "", r[3] or "")
        assert sorted(map(said, now.collect())) == sorted(map(said, rows)), name
    left = len(want[0]), len(want[1]), len(want[2]), len(want[3])
    assert left[0] < len(docs) and left[0] > left[1] > left[2] > left[3] > 300
    e = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect():
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    sizes = collections.defaultdict(list)
    for r in want[3]:
        sizes[r[0]].append(len(e.encode(r[1] or "")) + 1)
    assert {d: sum(n for _, n, _ in p) for d, p in pieces.items()} == {d: sum(n) for d, n in sizes.items()}
    for w, own in places.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == 4096 or w == max(places)


def test_the_pipeline_takes_empty_tables(spark, case, tmp_path):
    docs, labels, items = case
    write(spark, f"file://{tmp_path}/a", [], labels, items)
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/a").count() == 0
    write(spark, f"file://{tmp_path}/b", docs[:30], [], [])
    assert len({r.doc_id for r in corpus_pipeline.run(spark, f"file://{tmp_path}/b").collect()}) == 30
