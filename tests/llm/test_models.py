"""Language identification, toxicity and personal data."""

import hashlib
import random
import re

import numpy as np

from dashframe.llm import language_id, pii, toxicity
from dashframe.llm.crf import forward_backward, train
from tests.llm.helpers import docs, odd_rows, prose, row


def test_forward_backward_equals_enumeration():
    from itertools import product
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 1, 4])
    e, t = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    marginal, pairs, log_z = forward_backward(e, t, lengths, expected=True)
    want, want_pairs, want_z, at = np.zeros_like(e), np.zeros_like(t), 0.0, 0
    for n in lengths:
        z, m, p = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=int(n)):
            s = np.exp(sum(e[at + i, k] for i, k in enumerate(path))
                       + sum(t[a, b] for a, b in zip(path, path[1:])))
            z += s
            for i, k in enumerate(path):
                m[i, k] += s
            for a, b in zip(path, path[1:]):
                p[a, b] += s
        if n:
            want[at:at + n] = m / z
            want_pairs += p / z
            want_z += np.log(z)
        at += n
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_training_learns_transitions():
    # The words say nothing; labels always alternate.
    tokens = np.zeros(400, int)
    labels = np.tile([0, 1], 200)
    _, trans = train([np.array([0])], tokens, labels, np.full(40, 10), 1, 2)
    assert trans[0, 1] + trans[1, 0] > trans[0, 0] + trans[1, 1] + 2


GERMAN = "der die und nicht ein zu haus straße grün für über schön kalt licht garten winter".split()


def bilingual(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 2:
            rows.append(row(100 + i, " ".join(rng.choice(GERMAN) for _ in range(rng.randint(10, 60))), "de"))
        else:
            rows.append(row(100 + i, prose(rng, rng.randint(10, 60)), "en"))
    return rows


def test_language_of_held_out_documents(spark):
    rows = bilingual(120) + odd_rows()
    got = language_id.identify(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in bilingual(120)}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 10 and all(r.lang_pred == truth[r.doc_id] and 0.5 < r.score <= 1 for r in held)
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score, r.n_words) == ("und", 0.0, 0)


def test_switches_are_labelled_by_word(spark):
    model = language_id.fit([(r[2], r[1]) for r in bilingual(80)])
    import pyarrow as pa
    text = "the house walking under stone " * 4 + "der garten und nicht schön " * 4
    marginal, is_word, _ = model.label(pa.array([text.strip()]))
    best = marginal.argmax(axis=1)
    assert is_word.all() and (best[:20] == model.labels.index("en")).mean() >= 0.9 \
        and (best[20:] == model.labels.index("de")).mean() >= 0.9
    assert (best[1:] != best[:-1]).sum() <= 3


def test_language_without_labels(spark):
    got = language_id.identify(docs(spark, [row(1, "hello there", None), row(2, "...", "en")])).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got)
    assert language_id.identify(docs(spark, [])).collect() == []


def test_toxicity_of_held_out_documents(spark):
    rng = random.Random(31)
    rows, labels = odd_rows(), []
    for i in range(300):
        bad = i % 4 == 0
        words = prose(rng, rng.randint(30, 120)).split()
        if bad:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["scumbag", "scummy", "idiotic", "idiot!"])
        rows.append(row(500 + i, " ".join(words)))
        labels.append((500 + i, 1, int(bad), "x"))
    labels += [(1, 1, None, "x"), (None, 1, 1, "x"), (500, 1, 1, "x")]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.classify(docs(spark, rows), frame).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 500]
    assert len(held) > 50 and all(r.predicted == int((r.doc_id - 500) % 4 == 0) for r in held)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.classify(docs(spark, odd_rows()), none).collect()
    assert all(r.predicted == 0 and r.score < 1e-6 for r in got)
    assert toxicity.classify(docs(spark, []), none).collect() == []


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in
           re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in
            re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19),
                                       (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if least <= len(d) <= most and (kind == 3 or pii.luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(41)
    for _ in range(30000):
        t = "".join(rng.choice("a.@-+1 2(5)_.3é") for _ in range(rng.randint(0, 26)))
        assert brute_spans(t) == pii.base_spans(t), t
    t = "mail bob.x@site.example.org, 10.0.0.255 300.1.1.1 x 4111 1111 1111 1111 x 4111 1111 1111 1112 +49 (30) 123-4567"
    assert [k for _, k, _ in pii.base_spans(t)] == [k for _, k, _ in brute_spans(t)] == [0, 1, 2, 3]
    assert pii.base_spans("a" * 200000 + "@" + "1" * 200000 + "1.1." * 50000) is not None


def people(n):
    rng = random.Random(42)
    rows = []
    for i in range(n):
        number = "".join(rng.choice("23456789") for _ in range(7))
        text = (prose(rng, 12) + f" call +1555{number} now " + prose(rng, 12) + f" in {rng.randint(1900, 2020)} "
                + prose(rng, 8) + f" mail ann{i}@mail.example.com today")
        if i % 2:
            text += f" or call +1555{number} now"
        rows.append(row(100 + i, text))
    return rows


def test_repeated_entities_get_the_same_label(spark):
    rows = people(150)
    number = "2345678"
    rows.append(row(7, "call +1555" + number + " now the river and then call 1555" + number + " now over 1999 stones "
                    + prose(random.Random(1), 4000)))     # too long to be learned from
    got = {r.doc_id: r for r in pii.detect(docs(spark, rows + odd_rows()[:3])).collect()}
    for i, text, *_ in rows:
        base = brute_spans(text)
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
        assert (r.n_email, r.n_phone) == (sum(k == 0 for _, k, _ in base), sum(k == 3 for _, k, _ in base))
    text = rows[-1][1]
    at = text.index("1555" + number, 20)
    assert f"phone:{at}:{at + 11}" in got[7].spans.split(",")
    assert not any("1999" in text[int(a):int(b)] for _, a, b in
                   (s.split(":") for s in got[7].spans.split(",")))
    assert got[1].spans == got[2].spans == ""


def test_no_rows(spark):
    assert pii.detect(docs(spark, [])).collect() == []


def test_a_run_without_spaces_is_read_to_its_end():
    import pyarrow as pa
    model = language_id.fit([(r[2], r[1]) for r in bilingual(80)])
    rng = random.Random(9)
    en = "".join(prose(rng, 80).replace(",", "").split())[:320]
    de = "".join(rng.choice(GERMAN) for _ in range(100))[:320]
    marginal, is_word, offsets = model.label(pa.array(["the house", en + de, "", None, "kalt"]))
    assert offsets.tolist() == [0, 2, 12, 13, 14, 15] and len(marginal) == 15
    assert is_word.tolist() == [True] * 12 + [False, False, True]
    best = [model.labels[k] for k in marginal.argmax(axis=1)]
    assert best[2:12] == ["en"] * 5 + ["de"] * 5 and best[14] == "de"
