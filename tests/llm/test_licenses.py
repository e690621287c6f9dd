import random

import numpy as np

from pagelore.llm import licenses as L


def test_templates_are_found_wherever_they_are(spark):
    r = random.Random(2)
    noise = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed"]) + str(r.randint(0, 99)) for _ in range(n))
    rows, want = [], set()
    for k, (_, text) in enumerate(L.TEMPLATES):
        for j in range(6):
            body = text.upper() if j == 1 else text.replace(" ", " * ") if j == 2 else text
            rows.append((k * 10 + j, f"{noise(r.randint(0, 400))} {body} {noise(r.randint(0, 400))}"))
            want.add((k * 10 + j, k))
    rows += [(9000, None), (9001, ""), (9002, noise(30_000)), (9003, "rights all reserved license the under")]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(x.doc_id, x.template) for x in got}
    assert want <= found and not any(x.doc_id >= 9000 for x in got)
    texts = dict(rows)
    for x in got:
        assert x.containment >= 0.8
        assert len(L.WORD.findall(texts[x.doc_id][x.start : x.end])) <= len(L.WORD.findall(L.TEMPLATES[x.template][1])) * 2 + 4


def test_against_exact_containment():
    r = random.Random(3)
    templates = [(str(k), " ".join(r.choice("abcdefgh") for _ in range(n))) for k, n in enumerate((1, 3, 5, 6, 9, 17, 40))]
    index, hashes = L.Index(templates), L.WordHashes()
    docs = []
    for _ in range(60):
        ws = [r.choice("xyzuvw") + str(r.randint(0, 50)) for _ in range(r.randint(0, 120))]
        for _, t in r.sample(templates, 2):
            at = r.randint(0, len(ws))
            ws[at:at] = t.split()
        docs.append(hashes.of(" ".join(ws)))
    found = {(d, k) for d, k, *_ in index.matches(docs)}
    want = {(d, k) for d, ws in enumerate(docs) for k, own in enumerate(index.sets) if np.isin(own, L.shingles(ws, min(5, index.sizes[k]))).mean() >= L.CONTAINED}
    assert found <= want and len(found) >= 0.99 * len(want)


def test_blocks(monkeypatch):
    index, hashes = L.Index(L.TEMPLATES), L.WordHashes()
    text = " ".join([*["noise"] * 3000, L.TEMPLATES[0][1], *["noise"] * 3000])
    whole = index.matches([hashes.of(text)])
    monkeypatch.setattr(L, "BLOCK", 100)
    assert [x[:2] for x in index.matches([hashes.of(text)])] == [x[:2] for x in whole] != []


def test_empty(empty):
    assert L.scan(empty).count() == 0 and L.scan(empty, []).count() == 0


def test_every_occurrence_and_nested_licences(spark):
    by = {n: k for k, (n, t) in enumerate(L.TEMPLATES) if len(t) > 400}
    bsd2, bsd3, mit = (L.TEMPLATES[by[n]][1] for n in ("BSD-2-Clause", "BSD-3-Clause", "MIT"))
    filler = " ".join(f"word{i}" for i in range(90))
    rows = [(1, f"{mit} {filler} {mit}"), (2, bsd3), (3, bsd2), (4, f"{bsd3} {filler} {bsd2}"), (5, f"{mit} {mit} {mit}"), (None, mit), (6, mit), (6, mit)]
    got = L.scan(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, containment double")).collect()
    names = {}
    for x in sorted(got, key=lambda x: x.start):
        names.setdefault(x.doc_id, []).append(x.license)
    assert names == {1: ["MIT"] * 2, 2: ["BSD-3-Clause"], 3: ["BSD-2-Clause"], 4: ["BSD-3-Clause", "BSD-2-Clause"], 5: ["MIT"] * 3, None: ["MIT"], 6: ["MIT"] * 2}
    spans = sorted((x.start, x.end) for x in got if x.doc_id == 1)
    assert spans[0][1] <= len(mit) and spans[1][0] >= len(mit) + len(filler)


def test_recall_at_the_least_containment():
    """Copies with words replaced so that 0.8 to 0.9 of the shingles are left."""
    r = random.Random(9)
    templates = [(str(k), " ".join(f"{r.choice('abcdefgh')}{r.randint(0, 99)}" for _ in range(n))) for k, n in enumerate([30, 60, 150, 400] * 10)]
    index, hashes = L.Index(templates), L.WordHashes()
    found = wanted = 0
    for k, (_, text) in enumerate(templates):
        for _ in range(5):
            ws = text.split()
            for at in range(r.randint(0, 20), len(ws), 34):
                ws[at] = "other"
            noise = [f"x{r.randint(0, 999)}" for _ in range(120)]
            doc = hashes.of(" ".join([*noise[:60], *ws, *noise[60:]]))
            if np.isin(index.sets[k], L.shingles(doc, 5)).mean() >= L.CONTAINED:
                wanted += 1
                found += any(m[1] == k for m in index.matches([doc]))
    assert wanted > 100 and found >= 0.99 * wanted
