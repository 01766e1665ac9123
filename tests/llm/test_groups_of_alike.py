"""Groups whose members are alike but not linked don't meet pair by pair."""

import random

import numpy as np
from pyspark.sql import functions as F

from dashframe.llm import line_dedup, ngram_join
from tests.llm.helpers import docs, row
from tests.llm.test_line_dedup import kinds, word


def variants(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(1, len(w) - 1), changes):
            w[at] = word(rng) + str(rng.randrange(10 ** 6))
        out.append(w)
    return out


def test_documents_alike_but_not_linked(spark, monkeypatch):
    rng = random.Random(31)
    base = [word(rng) + str(i) for i in range(300)]
    texts = variants(rng, base, 120, 8)
    texts += [w[:150] + ["planted"] + w[151:] for w in texts[:5]]      # linked with one each
    pairs, stored = [], ngram_join.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "op5-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    got = ngram_join.classes(docs(spark, [row(i, " ".join(w)) for i, w in enumerate(texts)])).collect()
    sets = [{tuple(w[i:i + 3]) for i in range(len(w) - 2)} for w in texts]
    linked = [(i, j) for j in range(len(sets)) for i in range(j)
              if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j])]
    assert linked == [(i, 120 + i) for i in range(5)]
    want = {i: i for i in range(120)} | {j: i for i, j in linked}
    assert {r.doc_id: r.component_id for r in got} == want
    assert sum(pairs) < 5 * len(texts)                                  # of 7,140 pairs


def test_parities_never_differ_by_more_than_the_sets(spark):
    rng = random.Random(32)
    base = [word(rng) for _ in range(400)]
    texts = [" ".join(w) for k in (0, 1, 3, 10, 60) for w in variants(rng, base, 4, k)] + ["one", "two words", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "sid long, text string")
    odd = {r[0]: np.array(r[1:], np.int64).view(np.uint64)
           for r in ngram_join._parities(frame, ngram_join.Rule()).collect()}
    sets = [set(ngram_join.shingle_set(t.encode()).tolist()) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            differ = sum(int(x).bit_count() for x in odd[i] ^ odd[j])
            apart = len(sets[i] ^ sets[j])
            assert differ <= apart and (apart > 80 or differ >= 0.8 * apart - 4)


def test_a_pair_of_lines_leaves_the_join_once(spark):
    rng = random.Random(33)
    base = [word(rng) for _ in range(40)]
    lines = [" ".join(w) for w in variants(rng, base, 60, 2)]
    rows = line_dedup.line_rows(docs(spark, [row(i, x) for i, x in enumerate(lines)])).select("id", "norm")
    mixed = rows.select(F.explode(F.array(*[F.lit(b).cast("long") for b in (11, 12, 13)])).alias("bucket"), "id",
                        F.col("id").alias("part"), F.lit(1).alias("copies"), F.lit(60).alias("n"))
    met = [tuple(r) for r in line_dedup._met(mixed, rows).collect()]
    ids = [r.id for r in rows.collect()]
    part = kinds(lines)
    similar = {tuple(sorted((ids[i], ids[j]))) for i in range(60) for j in range(i)
               if 9 * len(line_shingles(lines[i]) & line_shingles(lines[j]))
               >= 4 * (len(line_shingles(lines[i])) + len(line_shingles(lines[j])))}
    assert similar <= set(met) and len(part) == 60
    assert len(met) <= 1.2 * len(set(met))           # not times the shingles and buckets they share


def line_shingles(line):
    return {line[i:i + 9] for i in range(max(1, len(line) - 8))}
