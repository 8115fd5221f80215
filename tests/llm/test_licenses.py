import random

import pytest

from quirefold.llm import licenses
from tests.llm.helpers import documents, odd_texts, prose


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def test_alignment_is_a_common_subsequence():
    chosen = random.Random(8)
    for _ in range(400):
        a = [chosen.choice("abcdefghijkl") for _ in range(chosen.randint(0, 25))]
        b = [chosen.choice("abcdefghijkl") for _ in range(chosen.randint(0, 12))]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:]))
        assert len(pairs) <= longest_common(a, b)
    # Texts without repeated words: anchors are the longest increasing run of places.
    for _ in range(200):
        a, b = chosen.sample("abcdefghij", 10), chosen.sample("abcdefghij", 8)
        assert len(licenses.align(a, b)) <= longest_common(a, b)
        assert licenses.align(b, b) == [(i, i) for i in range(8)]


def test_longest_increasing():
    chosen = random.Random(9)
    for _ in range(200):
        values = chosen.sample(range(50), chosen.randint(0, 12))
        found = licenses.longest_increasing(values)
        picked = [values[i] for i in found]
        assert picked == sorted(picked) and found == sorted(found)
        assert len(found) == longest_common(values, sorted(values))


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_notice_is_found_in_long_texts(name):
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    notice = licenses.TEMPLATES[name]
    for before, times in ((0, 1), (37, 1), (5000, 1), (100, 3)):
        text = prose(1, before) + "\n" + (notice.upper() + "\n") * times + prose(2, 900)
        found = scanner.scan(text)
        assert found["license"] == name and found["coverage"] == 1.0
        assert text[found["start"] : found["end"]] in notice.upper()


def test_changed_and_other_notices():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    words = licenses.TEMPLATES["mit-permission"].split()
    words[5] = words[9] = "something"
    found = scanner.scan(prose(3, 200) + " " + " ".join(words))
    assert found["license"] == "mit-permission" and 0.85 <= found["coverage"] < 1
    assert scanner.scan("Released under the Other License.")["license"] is None
    assert scanner.scan("License MIT the under released")["license"] is None


def test_tables(spark):
    rows = [*odd_texts(), (20, "x\nReleased under the MIT License."), (20, "x\nReleased under the MIT License.")]
    df = documents(spark, rows, clashing=True)
    found = [tuple(r) for r in licenses.scan_documents(df).collect()]
    assert len(found) == len(rows)
    assert [r for r in found if r[1]] == [(20, "mit", 1.0, 2, 32)] * 2
    assert licenses.scan_documents(documents(spark, [])).count() == 0


def names(text):
    return [f["license"] for f in licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD).scan_all(text)]


def test_versions_and_families_are_told_apart():
    for version, expected in ((1, []), (2, ["gpl-2.0"]), (3, ["gpl-3.0"])):
        assert names(f"x This work is licensed under the GNU General Public License, version {version}. x") == expected
    for family, expected in (("BY", "cc-by-4.0-short"), ("BY-SA", "cc-by-sa-4.0-short"), ("BY-NC", "cc-by-nc-4.0"), ("BY-NC-ND", "cc-by-nc-nd-4.0-short")):
        assert names(f"Licensed under CC {family} 4.0.") == [expected]
    assert names("Licensed under CC BY-NC 3.0.") == []
    for name in ("lgpl-2.1-header", "agpl-3.0-header", "gpl-2.0-header", "lgpl-3.0-text", "agpl-3.0-text", "gpl-3.0-text", "bsd-2-clause-text", "bsd-3-clause-text", "isc-text", "zlib-text"):
        assert names(prose(1, 50) + "\n" + licenses.TEMPLATES[name] + prose(2, 50)) == [name]


def test_a_part_of_a_license_is_not_the_license():
    whole = licenses.TEMPLATES["mit-permission"]
    assert names(whole) == ["mit-permission"] and names(whole[: len(whole) // 2]) == []


def test_two_licenses(spark):
    text = prose(1, 90) + licenses.TEMPLATES["isc-text"] + prose(2, 90) + " Licensed under CC BY-SA 4.0. " + prose(3, 90)
    found = licenses.find_licenses(documents(spark, [(1, text), (2, None)])).collect()
    assert [[f["license"] for f in r["licenses"]] for r in sorted(found)] == [["isc-text", "cc-by-sa-4.0-short"], []]
