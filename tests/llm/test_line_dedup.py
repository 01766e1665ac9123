import random
import re
from collections import defaultdict

from dashframe.llm import line_dedup
from tests.llm.helpers import docs, odd_rows, prose, row


def shingles(norm):
    return {norm[i:i + 9] for i in range(max(1, len(norm) - 8))}


def dropped(rows):
    """By comparing all pairs of lines."""
    places = defaultdict(list)
    for r in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        for p, line in enumerate(r[1].split("\n")):
            norm = line.strip(" \t\r\x0b\x0c").lower()
            if norm:
                places[norm].append((r[0] is None, r[0] or 0, r[1], p))
    lines = list(places)
    sets = [shingles(x) for x in lines]
    part = list(range(len(lines)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                part[find(i)] = find(j)
    kinds = defaultdict(list)
    for i, x in enumerate(lines):
        kinds[find(i)] += places[x]
    out = defaultdict(list)
    for group in kinds.values():
        first = min(group)[:3]
        for g in sorted(group):
            if g[:3] == first and g == min(x for x in group if x[:3] == first):
                continue
            out[None if g[0] else g[1], g[2]].append(g[3])
    return {k: sorted(v) for k, v in out.items()}


def test_lines(spark):
    rng = random.Random(8)
    stock = [prose(rng, rng.randint(8, 40)) for _ in range(40)]
    rows = odd_rows()
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 8)):
            w = rng.choice(stock).split()
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = "new%d" % rng.randrange(999)
            lines.append(rng.choice(["", "  "]) + " ".join(w) + rng.choice(["", "\r"]))
            if rng.random() < 0.2:
                lines.append("")
        rows.append(row(100 + i, "\n".join(lines)))
    got = line_dedup.line_report(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = dropped(rows)
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.n_lines, r.n_kept, tuple(r.dropped)))
    missed = wrong = total = 0
    for r in rows:
        if r[1] is None:
            assert (0, 0, ()) in found[r[0]]
            continue
        expect = set(want.get((r[0], r[1]), []))
        n = len(r[1].split("\n"))
        _, kept, lost = next(x for x in found[r[0]] if x[0] == n)
        assert kept == n - len(lost)
        total += len(expect)
        missed += len(expect - set(lost))
        wrong += len(set(lost) - expect)
    # Banding may miss a link (one of a hundred at similarity 0.8).
    assert total > 100 and missed <= 0.03 * total and wrong <= 0.03 * total


def test_dedup_lines(spark):
    frame = docs(spark, [row(1, "alpha beta gamma\n\ndelta"), row(2, "Alpha beta gamma \nother words"),
                         row(3, "delta"), row(4, None), row(5, ""), row(None, "other words")])
    left = line_dedup.dedup_lines(frame)
    assert left.columns == frame.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
    assert got == {1: ("alpha beta gamma\n\ndelta", 23), 2: ("other words", 11), 4: (None, None), 5: ("", 0)}


def test_no_python_in_the_plan(spark):
    plan = line_dedup.line_rows(docs(spark, odd_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_rows(spark):
    assert line_dedup.line_report(docs(spark, [])).collect() == []


def dense(line):
    return {line[i:i + 9] for i in range(max(1, len(line) - 8))}


def kinds(lines):
    """Partition of the lines by comparing all pairs on all 9-grams."""
    sets = [dense(x) for x in lines]
    part = list(range(len(lines)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if 9 * both >= 4 * (len(s) + len(sets[j])):
                part[find(i)] = find(j)
    return {i: find(i) for i in range(len(lines))}


def n_kept(spark, lines):
    got = line_dedup.line_report(docs(spark, [row(i, x) for i, x in enumerate(lines)])).collect()
    return {r.doc_id for r in got if r.n_kept}


def word(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))


def test_crowded_bucket_of_a_line_and_its_variants(spark):
    rng = random.Random(21)
    base = [word(rng) for _ in range(30)]
    lines = [" ".join(base)]
    for i in range(1000):
        at = rng.randrange(30)
        lines.append(" ".join(base[:at] + [word(rng)] + base[at + 1:]))
    want = len(set(kinds(lines).values()))
    assert len(n_kept(spark, lines)) == want <= 3


def test_crowded_bucket_of_unlike_lines_with_planted_pairs(spark):
    # A common phrase brings 1000 unlike lines together, 40 pairs among them.
    rng = random.Random(22)
    phrase = " ".join(word(rng) for _ in range(30))
    lines = []
    for i in range(960):
        tail = [word(rng) for _ in range(24)]
        lines.append(phrase + " " + " ".join(tail))
        if i < 40:
            tail[rng.randrange(24)] = word(rng)
            lines.append(phrase + " " + " ".join(tail))
    want = len(set(kinds(lines).values()))
    assert want <= 965
    assert abs(len(n_kept(spark, lines)) - want) <= 1


def test_recall_on_all_character_shingles(spark):
    # One-character edits, in lines with spaces and without.
    rng = random.Random(23)
    lines = []
    for i in range(300):
        line = ("" if i % 2 else " ").join(word(rng) for _ in range(rng.randint(15, 25)))
        at = rng.randrange(len(line))
        lines += [line, line[:at] + "#" + line[at + 1:]]
    part = kinds(lines)
    linked = [i for i in range(0, 600, 2) if part[i] == part[i + 1]]
    assert len(linked) >= 200
    gone = set(range(600)) - n_kept(spark, lines)
    found = sum(i + 1 in gone for i in linked)
    assert found >= 0.98 * len(linked)
    assert all(i - 1 in linked for i in gone)


def test_one_line_stays_whatever_shares_an_id(spark):
    long = "the first line of all that is repeated in other documents"
    rows = [row(1, long), row(1, long + "\nand another line of the same id"), row(None, long), row(None, long + "\nx"),
            row(None, long)]
    got = [(r.n_lines, tuple(r.dropped)) for r in line_dedup.line_report(docs(spark, rows)).collect()]
    kept = sum(n - len(d) for n, d in got)
    assert kept == 3 and sum(0 in d for _, d in got) == 4      # long once, and the two other lines
    # Without an id on any, the one of the smallest text hash keeps it.
    got = [tuple(r.dropped) for r in line_dedup.line_report(docs(spark, rows[2:])).collect()]
    assert sorted(map(len, got)) in ([0, 0, 1], [0, 1, 1])


def test_shingles_are_neither_sorted_nor_dealt(spark):
    plan = line_dedup._signed(line_dedup.line_rows(docs(spark, odd_rows())))._jdf.queryExecution() \
        .executedPlan().toString().split("Generate explode(sequence(")[0]
    assert "HashAggregate" in plan and "Sort" not in plan and "Exchange" not in plan


def test_signed_lines(spark):
    rows = [row(2, "A line\nother"), row(1, "a line "), row(None, "a line"), row(1, "a line ")]
    lines = line_dedup.line_rows(docs(spark, rows))
    got = {r.id: r for r in line_dedup._signed(lines).collect()}
    ids = {r.norm: r.id for r in lines.collect()}
    assert len(got) == 2
    assert [got[ids[x]].copies for x in ("a line", "other")] == [4, 1]
    assert [got[ids[x]].first_doc.of for x in ("a line", "other")] == [1, 2]


def test_signing_groups_by_numbers(spark):
    # A struct among the keys keeps a task's hash aggregate off its faster map.
    lines = line_dedup._signed(line_dedup.line_rows(docs(spark, [row(1, "alpha beta gamma"), row(None, "alpha beta gamma"),
                                                                 row(2, "delta\nalpha beta gamma")])))
    plan = lines._jdf.queryExecution().optimizedPlan()
    keys = plan.toString().split("Aggregate [", 1)[1].split("]")[0]
    assert len(keys.split(", ")) == 5 and "first_doc" not in keys
    got = {(r.copies, r.first_doc.no_id, r.first_doc.of) for r in lines.collect()}
    assert got == {(3, False, 1), (1, False, 2)} and lines.columns == ["id", "first_doc", "copies"] + [
        f"b{b}" for b in range(line_dedup.BANDS)]


def test_marks_refute_unlike_pairs_and_no_similar_one(spark):
    rng = random.Random(24)
    lines = ["ab" * 40, "ab" * 41 + "c", "short", "shorter"]
    for _ in range(12):
        base = [word(rng) for _ in range(rng.randint(6, 300))]
        lines.append(" ".join(base))
        for edits in (1, 2, 6):
            lines.append(" ".join(word(rng) if rng.random() < edits / len(base) else w for w in base))
    text = spark.createDataFrame(list(enumerate(lines)), "id long, norm string")
    marks = line_dedup._marks(text)
    assert {r.id: r.n for r in marks.collect()} == {i: max(1, len(x) - 8) for i, x in enumerate(lines)}
    pairs = [(i, j) for i in range(len(lines)) for j in range(i)]
    near = {(r.a, r.b): r.near for r in line_dedup._near(spark.createDataFrame(pairs, "a long, b long"), marks).collect()}
    sets = [dense(x) for x in lines]
    similar = {(i, j) for i, j in pairs if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert len(near) == len(pairs) and len(similar) > 20 and all(near[p] for p in similar)
    assert sum(near.values()) < len(pairs) / 4


def test_documents_are_split_once(spark):
    plan = line_dedup.dropped_lines(docs(spark, [row(1, "alpha beta\nalpha beta"), row(2, "alpha beta ")]))
    assert "posexplode" not in plan._jdf.queryExecution().toString()
    assert {(r.doc_id, tuple(r.dropped)) for r in plan.collect()} == {(1, (1,)), (2, (0,))}


def test_blanks_and_capitals(spark):
    rows = [row(1, " \tOne ΣΑΣ\x0b\r\nΟΔΟΣ\n\x0c \nİstanbul\n x"), row(2, "one σας\nοδος\nx")]
    got = [r.norm for r in line_dedup.line_rows(docs(spark, rows)).orderBy("doc_id", "pos").collect()]
    assert got == ["one σας", "οδος", "i̇stanbul", " x", "one σας", "οδος", "x"]


def test_a_chunk_of_shingles_is_signed_by_a_row(spark):
    line = "".join(chr(97 + i * 7 % 26) for i in range(52))        # 44 shingles
    chunks = line_dedup._chunks(spark.createDataFrame([(1, line), (2, "short")], "id long, norm string")
                                .select("id", line_dedup._units("norm").alias("units")), "id")
    assert [r["count"] for r in chunks.groupBy("id").count().orderBy("id").collect()] == [6, 1]
