"""The table of ratios of the toxicity models: grows with the corpus, keeps unlike words apart."""

import numpy as np

from clientele.llm import queries, textscan, toxicity
from tests.llm.data import odd_documents, prose

SF_DIR = "/root/testdata/sf0.001"


def slot_mates(bits: int = 20) -> list[str]:
    """Two words whose hashes agree in their lowest bits."""
    names = [f"w{i:05d}" for i in range(20_000)]
    hashes, _ = textscan.word_hashes([n.encode() for n in names])
    slots = (hashes & np.uint64((1 << bits) - 1)).tolist()
    seen: dict[int, str] = {}
    for name, slot in zip(names, slots):
        if slot in seen:
            return [seen[slot], name]
        seen[slot] = name
    raise AssertionError("no pair")


def test_words_of_one_slot_have_their_own_ratios(spark):
    """20 bits of these hashes are equal: one word only toxic, the other only ordinary."""
    bad, good = slot_mates()
    rows = [(f"{prose(i, 20)} {good if i % 2 else bad}", 1 - i % 2, i % 3) for i in range(40)]
    counted = toxicity.count_grams(spark.createDataFrame(rows, "text string, label int, fold int"))
    table, unknown = toxicity.word_ratios(counted)
    key = toxicity.words([f"{bad} {good}"])[0].tolist()
    ratio = {r["a"]: r["r3"] for r in table.collect()}
    assert ratio[key[0]] > unknown[3] + 1 and ratio[key[1]] < unknown[3] - 1


def test_letters_are_code_points():
    """Letters of one script are not folded: these share their first UTF-8 byte and 5 bits of the second."""
    one, other = (toxicity.letters([t])[:2] for t in ("漢字", "漢孧"))
    assert (one[1] != other[1]).sum() == 1
    cyrillic = [toxicity.table_key(toxicity.LETTERS, *toxicity.letters(toxicity._lower([t]))[:2]).tolist() for t in ("дом", "том", "ДОМ")]
    assert cyrillic[0] != cyrillic[1] and cyrillic[0] == cyrillic[2]
    a, b, first = toxicity.letters(["xyz", "", "ab  c"])
    alone = [toxicity.letters([t]) for t in ("ab  c",)][0]
    assert a[first[2]:first[3]].tolist() == alone[0].tolist() and b[first[2]:first[3]].tolist() == alone[1].tolist()


def test_probabilities_after_a_context_are_those_of_kneser_ney(spark, tmp_path):
    """Ratios of seen letters against the same levels, written as a plain loop."""
    rows = [("abracadabra cadabra", 0, 0), ("abba dab cab", 1, 1), ("bad abracad", 1, 2), ("cab cad", 0, 1)]
    counted = toxicity.count_grams(spark.createDataFrame(rows, "text string, label int, fold int"))
    got = {(r["a"], r["b"]): r["r3"] for r in toxicity.letter_ratios(counted, str(tmp_path / 'levels')).where("kind = 0").collect()}
    counts = [{}, {}]
    for text, label, _ in rows:
        a, b, _ = toxicity.letters([text])
        for key in zip(a.tolist(), b.tolist()):
            counts[label][key] = counts[label].get(key, 0) + 1
    two, one = (1 << 42) - 1, (1 << 21) - 1

    def shorter(keys, mask):
        out = {}
        for a, b in {(a, b): 0 for a, b in keys}:
            out[a & mask, b] = out.get((a & mask, b), 0) + 1
        return out

    def level(count, lower, a, b):
        here = [n for (x, _), n in count.items() if x == a]
        if not here:
            return lower
        return sum(min(n, 0.75) for n in here) / sum(here) * lower + max(count.get((a, b), 0) - 0.75, 0) / sum(here)

    every = set(counts[0]) | set(counts[1])
    shared = shorter(shorter(every, two), one)
    last = shorter(shared, 0)
    total = sum(n + 0.5 for n in last.values())
    for a, b in every:
        p = []
        for count in counts:
            low = level(shared, (last[0, b] + 0.5) / total, a & one, b)
            p.append(level(count, level(shorter(count, two), low, a & two, b), a, b))
        assert abs(got[a, b] - np.log(p[1] / p[0])) < 1e-4
    assert set(got) == every


def test_words_are_weighed_as_in_a_plain_loop(spark, tmp_path):
    """Ratios of words and what a text's different words say, against sets and dictionaries."""
    pool = ["idiot", "trash", "the", "cat", "sat", "on", "mat", "dog", "réeux", "x"]
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        label = int(rng.random() < 0.3)
        said = [*rng.choice(pool[2:], 6), *(rng.choice(pool[:2], 2) if label and i % 4 else [])]
        rows.append((" ".join(map(str, said)), label, i % 3))
    counted = toxicity.count_grams(spark.createDataFrame(rows, "text string, label int, fold int")).cache()
    table, unknown = toxicity.word_ratios(counted)
    got = {r["a"]: [r[f"r{j}"] for j in range(4)] for r in table.collect()}
    said = [{w: int(toxicity.words([w])[0][0]) for w in pool}[w] for w in pool]
    for j, skip in enumerate(toxicity.SKIPS):
        n = [[sum(w in t.split() and y == s and f != skip for t, y, f in rows) for w in pool] for s in (0, 1)]
        both = sum(map(sum, n)) + 0.5 * len(pool)
        back = [sum(min(k, 2.0) for k in n[s]) / sum(n[s]) for s in (0, 1)]
        assert np.isclose(unknown[j], np.log(back[1] / back[0]))
        for i in range(len(pool)):
            p = [back[s] * (n[0][i] + n[1][i] + 0.5) / both + max(n[s][i] - 2.0, 0) / sum(n[s]) for s in (0, 1)]
            assert np.isclose(got[said[i]][j], np.log(p[1] / p[0]), atol=1e-5)
    ratios = {h: r[3] for h, r in got.items()}
    keys = toxicity.table_key(toxicity.WORD, np.array(sorted(ratios)), np.zeros(len(ratios), np.int64))
    order = np.argsort(keys)
    sent = toxicity.Sent(keys[order], np.array([ratios[h] for h in sorted(ratios)], np.float32)[order])
    model = toxicity.Model("", "r3", unknown[3], np.zeros(4), own=sent)
    texts = ["idiot idiot the cat", "", None, "nobody knows these", "trash, IDIOT. réeux", "the cat sat on the mat"]
    found = model.ratios(texts)[:, 1]
    for text, value in zip(texts, found):
        parts = {w.strip(",.").lower() for w in (text or "").split()}
        say = [max(ratios[int(toxicity.words([w])[0][0])] - unknown[3] - 1.0, 0) for w in parts if w in pool]
        assert np.isclose(value, sum(say) / np.sqrt(1 + len(parts)), atol=1e-5)
    assert found[0] > 0 and found[4] > 0 and found[1] == found[2] == found[3] == 0


def test_rest_of_the_table_gives_the_same_scores(spark, monkeypatch):
    docs, labels = queries.read(spark, SF_DIR, "documents"), queries.read(spark, SF_DIR, "labels")
    both = docs.select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    scores = []
    for rows in (toxicity.SENT_ROWS, 300):
        monkeypatch.setattr(toxicity, "SENT_ROWS", rows)
        model = toxicity.toxicity_model(docs, labels)
        assert (model.rest is None) == (rows > 300) and len(model.keys) <= rows
        found = toxicity.score_toxicity(both, model).collect()
        scores.append(sorted((r["doc_id"] or -1, r["score"]) for r in found))
    assert len(scores[0]) == len(scores[1]) == both.count() and np.allclose(*scores, atol=1e-9)
