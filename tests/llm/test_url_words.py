import random

import pytest

from larkspur.llm import urls
from larkspur.llm.queries import URL_RULES


@pytest.mark.parametrize("block", [urls.BLOCK, 20_000])
def test_all_title_words_are_known(spark, block):
    """More words that occur once than were ever kept, and one of more than 24 letters."""
    random.seed(5)
    names = sorted({"".join(random.choices("bcdfghjklmnpqrstuvwz", k=9)) for _ in range(60_000)})
    long = "donaudampfschifffahrtsgesellschaft"
    titles = [" ".join(names[i:i + 1000]) for i in range(0, len(names), 1000)] + [long]
    pairs = [random.sample(names, 2) for _ in titles[2:]] + [[long]]
    pages = spark.createDataFrame([(i, f"https://{''.join(p)}.org/{p[0]}", f"<title>{t}</title>") for i, (t, p) in enumerate(zip(titles, [["none"]] + pairs))], "page_id long, url string, html string")
    out = {r.page_id: r.words for r in urls.url_verdicts(pages, URL_RULES, block).collect()}
    assert [out[i] for i in range(1, len(titles))] == [[*p, p[0]] for p in pairs]


def test_without_titles_and_ids(spark):
    pages = spark.createDataFrame([(None, "https://cheappills.org/en", None), (None, "https://cheappills.org/en", None), (1, None, "x")], "page_id long, url string, html string")
    out = [(r.page_id, r.words, r.verdict) for r in urls.url_verdicts(pages, []).collect()]
    assert sorted(out, key=str) == sorted([(None, ["cheap", "pills", "en"], "block")] * 2 + [(1, [], "allow")], key=str)
