import random
import re

from dashframe.llm import quality
from tests.llm.helpers import docs, odd_rows, prose, row


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= set(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def corpus():
    rng = random.Random(11)
    rows = odd_rows()
    for i in range(300):
        rows.append(row(1000 + i, prose(rng, rng.randint(40, 300)), rng.choice(["en", "de"]), "s%d" % (i % 3)))
    for i in range(6):
        rows.append(row(2000 + i, " ".join(w + "&&&" for w in prose(rng, 60).split()), "en", "s0"))
    rows.append(row(3000, (prose(rng, 12) + " ") * 6, "en", "s0"))
    rows.append(row(3001, prose(rng, 100), "fr", "new"))       # a group of one: pooled
    return rows


def test_statistics_and_verdicts(spark):
    rows = corpus()
    got = quality.quality(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in rows:
        n, chars, symbols, dup, rep = brute(text) if len(text or "") < 4000 else quality.stats_of(text.encode())[:5]
        want = (n, chars, symbols, dup, rep, n < 20 or 100 * rep > 30 * n)
        assert want in [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                        for r in by[i]]
    kept = {r.doc_id for r in got if r.kept}
    assert all(1000 + i in kept for i in range(300)) and 3001 in kept
    assert not any(2000 + i in kept for i in range(6)) and 3000 not in kept


def test_long_text_statistics():
    rng = random.Random(12)
    for n in (7, 8, 9, 16, 200, 900):
        t = " ".join(rng.choice("ab") for _ in range(n)) + "\nx#\nx#\n\n"
        assert quality.stats_of(t.encode())[:5] == brute(t)


def test_distance_cannot_be_bought_by_outliers(spark):
    # A fifth of the group is junk; the estimate still rests on the rest.
    rng = random.Random(13)
    rows = [row(i, prose(rng, rng.randint(50, 150)) if i % 5 else
                " | ".join(prose(rng, 80).split())) for i in range(200)]
    kept = {r.doc_id for r in quality.quality(docs(spark, rows)).where("kept").collect()}
    assert kept == {i for i in range(200) if i % 5}


def test_keep_good(spark):
    rng = random.Random(14)
    frame = docs(spark, [row(i, prose(rng, 60)) for i in range(5)] + [row(9, "short"), row(8, None)])
    left = quality.keep_good(frame)
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} == set(range(5))


def test_no_rows(spark):
    assert quality.quality(docs(spark, [])).collect() == []


def test_moderate_junk_is_rejected(spark):
    rng = random.Random(15)
    rows = [row(i, "\n".join(prose(rng, 12) for _ in range(rng.randint(6, 20)))) for i in range(300)]
    for i in range(10):
        # 30 to 50 % punctuation; repeated short lines among others.
        share = 0.3 + 0.02 * i
        words = prose(rng, 150).replace(",", "").split()
        rows.append(row(1000 + i, " ".join(w + "." * round(len(w) * share / (1 - share) + 0.5) for w in words)))
        rows.append(row(2000 + i, "\n".join(prose(rng, 9) + "\nread more" for _ in range(12))))
    got = quality.quality(docs(spark, rows)).collect()
    assert not any(r.base_failed for r in got)
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept & set(range(300))) >= 297
    assert not kept & (set(range(1000, 1010)) | set(range(2000, 2010)))
