"""The filter audit against orders applied one by one."""

from itertools import permutations

import pytest

from kerbline.llm import filter_audit as audit

DOCS = "doc_id long, text string, source string, mask string, n string"
LABELS = "doc_id long, quality int, toxic int, good string"


def corpus():
    plain = " ".join(f"word{i}" for i in range(60))
    texts = [plain, plain, "few words", "few words", "A" * 80, None, "", " \t\n", "x " * 60, "x " * 60 + "#", plain + " $", "ÀÉ ABC % " * 40]
    texts += ["very " + "long text " * 30_000, plain.upper(), "few words"]
    rows = [(i * 3 % 17, text, "ab"[i % 2] if i % 5 else None) for i, text in enumerate(texts)]
    rows += [rows[0], rows[0], (None, plain, "a"), (None, "only without an id", "b"), (None, "only without an id", "b"), (1, plain, "b")]
    return [(*row, "m", "n") for row in rows]


def labels():
    rows = [(i, i % 2, int(i % 4 == 1)) for i in range(0, 17, 2)]
    rows += [(3, None, 1), (5, 1, None), (None, 1, 1), (2, 1, 0), (99, 1, 1)]
    return [(*row, "g") for row in rows]


def plain_audit(docs, flags):
    """Every part and order, filter by filter."""
    def fails(row):
        text, words = row[1] or "", (row[1] or "").encode().split()
        found = set()
        if len(words) < 50:
            found.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            found.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
            found.add("C")
        if any(c in "#$%&*|" for c in text):
            found.add("D")
        known = [r[0] for r in docs if (r[1] or "") == text and r[0] is not None]
        if known and (row[0] is None or row[0] > min(known)):
            found.add("E")
        return found

    good = {r[0] for r in flags if r[1] == 1 and r[0] is not None}
    toxic = {r[0] for r in flags if r[2] == 1 and r[0] is not None}
    rows = [(r[2] or "", r[0], fails(r)) for r in docs]
    out = {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            kept = own = [r for r in rows if r[0] == part]
            for step, letter in enumerate(order, 1):
                removed = [r for r in kept if letter in r[2]]
                kept = [r for r in kept if letter not in r[2]]
                out[part, "".join(order), step] = [
                    len(kept),
                    len(removed),
                    sum(letter in r[2] for r in own) - len(removed),
                    sum(r[2] == {letter} for r in own),
                    sum(r[1] in good for r in removed),
                    sum(r[1] in toxic for r in removed),
                ]
    for key in list(out):
        letter = key[1][key[2] - 1]
        out[key].append(sum(v[1] for (part, order, step), v in out.items() if part == key[0] and order[step - 1] == letter))
    return out


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_orders_applied_one_by_one(spark):
    docs = spark.createDataFrame(corpus(), DOCS).repartition(4)
    got = audit.audit(docs, spark.createDataFrame(labels(), LABELS)).collect()
    assert len(got) == 3 * 120 * 5
    assert {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in got} == plain_audit(corpus(), labels())


def test_empty_tables(spark):
    docs, flags = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit(docs, flags).count() == 0
    rows = audit.audit(spark.createDataFrame(corpus()[:1], DOCS), flags).collect()
    assert len(rows) == 600 and all(r.good_lost == r.toxic_lost == 0 for r in rows)


def test_path_counts_weigh_all_orders():
    forward, backward = audit.path_counts(4)
    assert forward[0b1011] == 6 and backward[0b0001] == 6 and forward[15] == backward[0] == 24
    for bit in range(4):
        assert sum(w for _, own, w, _ in audit.edges("ABCD") if own == bit) == 24
    assert all(weight == len(steps) for _, _, weight, steps in audit.edges("ABCD"))


def test_too_many_filters_are_refused(spark):
    with pytest.raises(ValueError, match="at most 7"):
        audit.audit_counts(spark.createDataFrame([], "part string, mask int, n long, good long, toxic long"), "ABCDEFGH")
