import re

from folioscope.llm import licenses


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def by_hand(text):
    """Every window compared with every template, without bands."""
    w, names, best = words(text), [], 0.0
    s = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    for name, template in sorted(licenses.TEMPLATES.items()):
        t = words(template)
        own = {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
        stride, window = max(1, len(t) // 2), 2 * len(t) - 2
        share = max((len(own & set(s[k : k + window])) / len(own) for k in range(0, max(len(s), 1), stride)), default=0)
        if share >= licenses.CONTAINMENT:
            names.append(name)
            best = max(best, share)
    return len(w), len(names), ",".join(names), best


def check(docs):
    got = sorted((tuple(r) for r in licenses.scan(docs).collect()), key=repr)
    assert got == sorted(((r.doc_id, *by_hand(r.text)) for r in docs.collect()), key=repr)


def test_planted_statements(spark):
    filler = " ".join(f"filler{i}" for i in range(300))
    rows = [(i, f"{filler[: 7 * i]} {t.upper() if i % 2 else t}; {filler}") for i, t in enumerate(licenses.TEMPLATES.values())]
    rows += [(50, "licensed under the apache license version three"), (51, "Released under the BSD License"),
             (52, "This work is licensed under the GNU Special Public License, version 3")]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_other_rows(hard, clashing, small, empty):
    check(hard)
    check(clashing.select("*"))
    check(small)
    assert licenses.scan(empty).count() == 0


def test_plan_is_native_and_has_no_shuffle(small):
    plan = licenses.scan(small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Join", plan)
