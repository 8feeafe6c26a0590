from ledgerloom.llm.licences import SENTENCES, scan_licences


def test_rules(docs_of):
    mit = "\n\n".join(SENTENCES[k][0] for k in ("MITgrant", "MITnotice", "MITwarranty", "MITliability"))
    wrapped = mit.replace(" of ", "\nof ")
    cases = [(1, "Prose.\nReleased under the MIT License.\nMore."), (2, mit), (3, wrapped), (4, "LICENSED under CC BY-NC 4.0"), (5, None), (6, ""),
             (7, "All rights reserved. Licensed under the Apache License, Version 2.0. Nothing else."), (8, "He wrote about the MIT license in a book."),
             (9, SENTENCES["GPLfree3"][0] + " " + SENTENCES["MITname"][0]), (1, "Prose.\nReleased under the MIT License.\nMore."),
             (None, "word. " * 20_000 + "Licensed under CC BY-NC 4.0.")]
    got = sorted(((r["doc_id"] or 0, r["licences"], r["n_known"], r["unmatched"]) for r in scan_licences(docs_of(cases, "ids run")).collect()))
    assert got == [(0, "CC-BY-NC-4.0", 1, 0), (1, "MIT", 1, 0), (1, "MIT", 1, 0), (2, "MIT", 4, 0), (3, "MIT", 4, 0), (4, "CC-BY-NC-4.0", 1, 0),
                   (5, "", 0, 0), (6, "", 0, 0), (7, "Apache-2.0", 2, 1), (8, "", 0, 0), (9, "GPL-3.0-or-later,MIT", 2, 0)]
    assert scan_licences(docs_of([])).count() == 0
