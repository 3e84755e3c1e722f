"""Very long texts and candidates: whole, and in time that grows with them."""

import time

from quern.llm import license_scan, line_dedup, secret_scan


def test_license_scan_of_blank_lines_and_notices_in_sentences():
    find = license_scan.Templates().find
    start = time.time()
    assert find("licensed" + "\n" * 100_000 + "license MIT") == []
    assert time.time() - start < 5
    text = "The whole project is released under the MIT License and more text follows here, for all."
    (a, b, name, d), = find(text)
    assert (text[a:b], name, d) == ("released under the MIT License", "MIT", 1.0)
    long = "word " * 50_000 + "\n\n" + "Released under the MIT License.\n" + "word " * 50_000
    assert [f[2] for f in find(long)] == ["MIT"]


def test_secret_features_see_the_whole_candidate():
    head = "aB3" * 200
    assert secret_scan.features("key = ", head + "x" * 400, "", "")[:4] != secret_scan.features("key = ", head + "q7Z" * 140, "", "")[:4]


def test_long_lines_are_compared():
    words = [f"word{i * 7919 % 5003}" for i in range(20_000)]
    other = [*words[:100], "new", *words[120:15_000], "other", *words[15_000:]]
    start = time.time()
    assert line_dedup.alike(" ".join(words), " ".join(other))
    assert not line_dedup.alike(" ".join(words), " ".join(words[:10_000]))
    assert time.time() - start < 2
