"""Common formats that the generated tables do not hold."""

from knowlattice.llm import pii

FOUND = [
    "+49 30 12345678", "+33 6 12 34 56 78", "0171 2345678", "01 23 45 67 89", "01.23.45.67.89", "030/1234567", "(030) 1234567", "+49 (0)30 1234567", "612 345 678", "91 123 45 67", "0049 171 2345678",
    "3782 822463 10005", "378282246310005", "4222222222222", "6304000000000000000", "30569309025904",
    "2001:db8:85a3::8a2e:370:7334", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "::1", "fe80::1",
    "John Smith", "Sarah Connor", "Jürgen Müller", "François Dupont",
    "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abcDEF123_-x",
]
SECRETS = ["password=hunter2hunter2", "api_key: 9f8e7d6c5b4a", "TOKEN = 'abcdefgh1234'", "Authorization: Bearer abcdef0123456789ABCDEF", "secret=p@ssw0rd.99x", "PASSWORD=correcthorse"]
LEFT = ["on 01.02.2024", "at 12:30:45", "std::vector and a::b", "password: remember it", "token = get_token(user)", "1.234.567 of 2024-05-06", "0.12345678", "ratio 3:2, id 17"]


def test_formats(spark):
    rows = list(enumerate([f"so {x} here" for x in FOUND] + SECRETS + LEFT + ["to user@mail.company.com, a@firm.co.uk"]))
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = [out[i].text for i, _ in rows]
    bad = [(old, new) for (_, old), new in zip(rows, texts[: len(FOUND)]) if old[3:-5] in new or out[_].n_entities != 1 or not (new.startswith("so ") and new.endswith(" here"))]
    assert not bad
    for old, new in zip(SECRETS, texts[len(FOUND) :]):
        value = old.replace("'", "").split("=")[-1].split(": ")[-1].split()[-1]
        assert value not in new and old[:6] == new[:6] and "ssw0rd" not in new, (old, new)
    assert texts[-1 - len(LEFT) : -1] == LEFT
    assert "company" not in texts[-1] and "firm" not in texts[-1] and ".com," in texts[-1] and texts[-1].endswith(".co.uk")
