import pytest

from spanloom.functions.text import explode_tokens, token_list
from spanloom.operators import words
from spanloom.operators.sentences import explode_sentences


def plain(docs, found, starts, reach):
    """Each sentence looks at every place in its reach."""
    out = []
    for (doc, idx), (start, n) in starts.items():
        texts, wanted = docs[doc], found.get((doc, idx), set())
        at = [(i, texts[i]) for i in range(start, min(len(texts), start + max(n, reach))) if texts[i] in wanted]
        if at:
            out.append((doc, idx, min(i for i, _ in at), max(i for i, _ in at), len({t for _, t in at})))
    return sorted(out)


@pytest.mark.parametrize("reach", [5, 500])
def test_anchor_ranges(spark, reach):
    filler = " ".join(f"Plain number{i % 7} again and again the same." for i in range(120))
    long = " ".join(f"wording{i}" for i in range(700))
    rows = [(1, f"{filler} Finally elephants arrived."), (2, f"First {long} zebras12. {filler}"), (3, None), (4, "Elephants, elephants! Elephants?")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stream = explode_tokens(df, "doc_id", "text").withColumnRenamed("token", "word")
    got = sorted(tuple(r) for r in words.anchor_ranges(df, reach=reach).collect())
    docs, found = {}, {}
    for r in stream.orderBy("doc_id", "pos").collect():
        docs.setdefault(r.doc_id, []).append(r.word)
    for r in words.anchors(df).collect():
        found.setdefault((r.doc_id, r.idx), set()).add(r.token)
    of, before = {}, {}
    for r in explode_sentences(df).orderBy("doc_id", "idx").collect():
        n, start = len(token_list(r.sentence)), before.get(r.doc_id, 0)
        of[r.doc_id, r.idx], before[r.doc_id] = (start, n), start + n
    assert got == plain(docs, found, of, reach)
    # no sentence with anchors is lost, wherever it stands
    assert {(doc, idx) for doc, idx, *_ in got} == set(found)
    assert max(high for doc, _, _, high, _ in got if doc == 1) == len(docs[1]) - 1
