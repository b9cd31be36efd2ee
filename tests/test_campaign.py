"""The comment cascade on invented comments, one for each way through it."""

import pytest

from corvella.operators import campaign as C

PROSE = "We have farmed this valley for forty years and the proposed limits on spring water would leave our lower fields dry by early June every season. "
FORM = "Re: docket 7\n\"Please protect the wild river from the new dam because salmon need cold moving water to spawn and families need clean places to swim each long summer with their children\"\nSincerely,\n"


def pages(*texts):
    return "".join(f"<<PAGE {i}>>\n{t}\n" for i, t in enumerate(texts, 1))


LETTER = "Dear Secretary,\n" + PROSE * 4
NAMES = "\n".join(f"Ann{c} Miller{c}, Springfield" for c in "abcdefghij")
CASES = {
    "text box only": ("definitely_single", f"<<PART 1>>\nfalse\n\n0\n\n{PROSE}", None),
    "text box and failed scans": ("definitely_single", f"<<PART 1>>\nfalse\n\n0\n\n{PROSE}\n<<PART 2>>\n<<PAGE 1>>\n» ~= |\n~ x {{}} ^^ | = <> ~~ ||", None),
    "cover letter with a count": ("definitely_campaign", "<<PART 1>>\nfalse\n\n0\n\nSee Attached\n<<PART 2>>\n" + pages("Attached please find 12,340 individual public comments. Individual comments may differ, the majority read as follows: save it") + "<<PART 3>>\n" + pages(FORM + "Ann", FORM + "Bob", FORM + "Cy"), None),
    "count in the metadata too": ("definitely_campaign", "<<PART 1>>\nfalse\n\n4000\n\nSee Attached\n<<PART 2>>\n" + pages("On behalf of River Friends I am submitting 4,100 comments demonstrating opposition. They are split across 9 attachments."), None),
    "one attached letter": ("definitely_single", "<<PART 1>>\nfalse\n\nSee attached file(s)\n<<PART 2>>\n" + pages(LETTER, "Second page of other words: " + "bridges culverts gravel roads fences wells " * 6), None),
    "on behalf of alone": ("definitely_single", "<<PART 1>>\nfalse\n\nPlease see attached\n<<PART 2>>\n" + pages("On behalf of the county board we write. " + LETTER), None),
    "part of another submission": ("references_other_submission", f"<<PART 1>>\nfalse\n\n0\n\nThis is submission 2 of 5 of our exhibits.\n<<PART 2>>\n{pages(LETTER)}", None),
    "names its parent": ("references_other_submission", "<<PART 1>>\nfalse\n\n0\n\nThe primary submission ID is abc-123456x\n", None),
    "cited references": ("references_other_submission", "<<PART 1>>\nfalse\n\n0\n\nReferences cited in the comment of our group\n", None),
    "pages that repeat": ("uncertain", "<<PART 1>>\nfalse\n\n0\n\nhere\n<<PART 2>>\n" + pages(*(FORM + n for n in ("Ann", "Bob", "Cy", "Di"))), None),
    "appendix that repeats": ("definitely_single", f"<<PART 1>>\nfalse\n\n0\n\n{PROSE * 4}\n<<PART 2>>\n" + pages(*(FORM + n for n in ("Ann", "Bob", "Cy"))), None),
    "title of a campaign, little text": ("definitely_campaign", "<<PART 1>>\nfalse\n\n0\n\nsample\n", "Mass Comment Campaign sponsored by River Friends"),
    "title of a campaign, much text": ("definitely_single", f"<<PART 1>>\nfalse\n\n0\n\n{PROSE * 6}", "mass mailing"),
    "coalition letter": ("definitely_single", "<<PART 1>>\nfalse\n\n0\n\nhello\n<<PART 2>>\n" + pages(LETTER, NAMES, LETTER), None),
    "signature packet": ("definitely_single", "<<PART 1>>\nfalse\n\n0\n\nhello\n<<PART 2>>\n" + pages(*["DocuSign Envelope ID: 9A8B"] * 4), None),
    "old markers": ("definitely_single", f"<<COMMENT 1>>\nfalse\n\n0\n\n{PROSE}", None),
    "nothing": ("uncertain", "", None),
    "null": ("uncertain", None, None),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(name, raw, title) for name, (_, raw, title) in CASES.items()]
    frame = spark.createDataFrame(rows, "name string, raw string, title string").repartition(2)
    return {r["name"]: r for r in C.classify(frame, text_col="raw", title_col="title").collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_cases(judged, name):
    assert judged[name]["classification"] == CASES[name][0], judged[name]


def test_details(judged):
    assert judged["cover letter with a count"]["campaign_count"] == 12340 and judged["count in the metadata too"]["campaign_count"] == 4100
    assert judged["names its parent"]["parent_id"] == "abc-123456x"
    assert judged["pages that repeat"]["repetition"] == 1.0 and judged["pages that repeat"]["campaign"] == 2
    assert judged["on behalf of alone"]["phrases"] == ["on behalf of"] and judged["on behalf of alone"]["hints"] == 1
    assert judged["text box only"]["n_parts"] == 1 and judged["coalition letter"]["n_pages"] == 3
