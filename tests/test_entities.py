import random
import re

from ledgerloom.operators.entities import find_known_names
from ledgerloom.plans.jobs import documents_from_folder, process_documents

NAMES = [("Ada Mill", "ORG"), ("Mill", "ORG"), ("Ada", "PERSON"), ("ada  mill", "ZZZ"), ("B & C, Ltd", "ORG"), ("...", "ORG"), (None, "ORG")]


def words(text):
    return re.findall(r"\w+|\n", (text or "").lower())


def brute(text):
    """All names at all places, without those inside another one."""
    best = {}
    for name, label in NAMES:
        if words(name):
            key = tuple(words(name))
            best[key] = min(best.get(key, (label, name)), (label, name))
    found = words(text)
    hits = [(i, i + len(k), best[k]) for k in best for i in range(len(found)) if tuple(found[i:i + len(k)]) == k]
    kept = [h for h in hits if not any(o[0] <= h[0] and h[1] <= o[1] and o[:2] != h[:2] for o in hits)]
    return [(name, label, at) for at, _, (label, name) in sorted(kept)]


def test_known_names(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choices(["Ada", "MILL", "b", "&", "c,", "ltd", "x", "\n"], k=draw.randint(0, 30))) for _ in range(200)]
    texts += [None, "", "Ada\nMill", "Adamill", "Ada Mill " * 3000]
    names = spark.createDataFrame(NAMES, "name string, label string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS label", "2 AS gram")
    got = {r["doc_id"]: [tuple(e) for e in r["entities"]] for r in find_known_names(df, names).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert find_known_names(df, names).columns == [*df.columns, "entities"]
    assert all(not r["entities"] for r in find_known_names(df, names.limit(0)).collect())
    assert find_known_names(df.limit(0), names).count() == 0


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes("Invoice No: INV-77\nFrom: Ünique Ltd".encode())
    (tmp_path / "b.png").write_bytes(b"\xff\xfe not text")
    (tmp_path / "c.docx").write_bytes(b"Invoice No: X-1")
    got = {r["filename"]: r for r in process_documents(documents_from_folder(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.pdf", "b.png"} and got["a.pdf"]["success"] and got["a.pdf"]["invoice_number"] == "INV-77"
    assert not got["b.png"]["success"] and got["b.png"]["error"] == "No pages could be loaded from file"
