"""The field of op9 on sentences that neither its generator nor its shapes were written from."""

import pytest

from colloquy.llm import pii

DATA = "/root/testdata/sf0.001"

#: Sentence, kind, entity.
FOUND = [
    ("You can mail anna at birchwood.org for the slides.", "email", "anna at birchwood.org"),
    ("Write to j.keller at uni-example.de before Friday.", "email", "j.keller at uni-example.de"),
    ("My handle is tom_reed at fastpost.net, thanks.", "email", "tom_reed at fastpost.net"),
    ("Questions go to sales (at) northwind.co as always.", "email", "sales (at) northwind.co"),
    ("The list owner is info [at] riverbank [dot] org", "email", "info [at] riverbank [dot] org"),
    ("E-mail: paula at cedar dot com", "email", "paula at cedar dot com"),
    ("or contact lee.wong at harbor.io about the boat", "email", "lee.wong at harbor.io"),
    ("bob(at)example(dot)com is where it ends up", "email", "bob(at)example(dot)com"),
    ("Please send it to r2d2 at droids.net by noon", "email", "r2d2 at droids.net"),
    ("He signs as marie-claire [at] atelier.fr these days", "email", "marie-claire [at] atelier.fr"),
    ("Mail: hugo at lindgren.se", "email", "hugo at lindgren.se"),
    ("Call 415 555 0132 after six.", "phone", "415 555 0132"),
    ("Our office, (212) 555-0187, is closed on Monday.", "phone", "(212) 555-0187"),
    ("The fax is 617.555.0123 still", "phone", "617.555.0123"),
    ("Ring 020 7946 0958 and ask for Jo.", "phone", "020 7946 0958"),
    ("Tel. 030/1234567 (weekdays)", "phone", "030/1234567"),
    ("Phone: 06 12 34 56 78", "phone", "06 12 34 56 78"),
    ("From abroad it is 0049 30 901820 instead.", "phone", "0049 30 901820"),
    ("His mobile 0171 2345678 was off.", "phone", "0171 2345678"),
    ("1-800-555-0199 is free of charge", "phone", "1-800-555-0199"),
    ("Dial 555-0147 now", "phone", "555-0147"),
    ("The number 503-555-0170 rang twice.", "phone", "503-555-0170"),
    ("(04131) 789456 is the desk", "phone", "(04131) 789456"),
    ("She paid with 4111.1111.1111.1111 at the door", "card", "4111.1111.1111.1111"),
    ("charge 5500/0000/0000/0004 twice", "card", "5500/0000/0000/0004"),
    ("My card 3782.822463.10005 has expired", "card", "3782.822463.10005"),
    ("6011.0009.9013.9424 was declined", "card", "6011.0009.9013.9424"),
    ("Block 10[.]0[.]0[.]12 at once", "ip", "10[.]0[.]0[.]12"),
    ("ping 192 dot 168 dot 1 dot 20 first", "ip", "192 dot 168 dot 1 dot 20"),
    ("the server 172(.)16(.)254(.)1 is down", "ip", "172(.)16(.)254(.)1"),
    ("Resolver 8[dot]8[dot]8[dot]8 answers", "ip", "8[dot]8[dot]8[dot]8"),
]

#: What is no personal data; the first lines are sentences that an earlier field fell for.
CLEAN = """
look at www.site.com for more
see us at example.org today
he works at google.com now
talk at pycon.org
published at news.bbc.co.uk
hosted at git.example.net
buy it at shop.example.com
contact me at example.com
read more at www.example.com
we met at noon.Then we left
order 123-456-7890
coordinates 100-200-3000
ratio 300 400 5000
IBAN DE89 3704 0044 0532 0130 00
The workshop at nordic.ai was full
Registration opens at conf.example.io
Our team at acme.io grew quickly
Find the sources at code.example.org
a session held at fosdem.org
They stay at hotel.com rates
sold at amazon.de since May
Get tickets at eventim.de
invoice 2023-0045-0012
Part no. 300-400-5000
the scores were 21-15 21-18
ISBN 978-3-16-148410-0
between 1000 2000 and 3000 units
population 3 645 000
MAC 00:1B:44:11:3A:B7
lat 52.5200, 13.4050
2024-05-06 07:08:09
pointer 0x7ffde3a1
tracking 1Z 999 AA1 01 2345 6784
total 1 234 567.89
rows 100 200 300 400
GB29 NWBK 6016 1331 9268 19
order #4000-1234
SKU 123 456 789
sequence 1 2 3 4 5 6 7 8 9
size 10 20 30
page 0171 of 2345
5-4-3-2-1 and go
Sections 2.1.1 to 2.1.9
a code 1234567890123456 of sixteen digits
at 10.30 we left
arrived at 9.45 at gate 12
Students at mit.edu voted
We were guests at villa.it
Prices at store.example.com fell
the sum 12 + 34 = 46
chapter 12, verses 3-15
He scored 100 200 times
case 2019-CV-00123
temperature 12.5 to 17.25
built in 1998-1999
Look for jobs at careers.example.com
the exhibition at tate.org.uk
lunch at bistro.paris was fine
version 2.0.1-rc.3
id 55501234567
""".strip().splitlines()


@pytest.fixture(scope="module")
def weights(spark):
    return pii.fit_pii(spark.read.parquet(f"{DATA}/documents.parquet"))


def spans(text, weights):
    return {(kind, text[a:b]) for kind, found in pii.all_spans(text, weights)[1].items() for a, b in found}


def test_precision_and_recall_on_sentences_of_others(weights):
    right = sum((kind, entity) in spans(text, weights) for text, kind, entity in FOUND)
    wrong = sum(len(spans(text, weights) - {(kind, entity)}) for text, kind, entity in FOUND) + sum(len(spans(text, weights)) for text in CLEAN)
    assert right / len(FOUND) >= 0.9, [(t, spans(t, weights)) for t, k, e in FOUND if (k, e) not in spans(t, weights)]
    assert right / (right + wrong) >= 0.9, [(t, spans(t, weights)) for t in CLEAN if spans(t, weights)]


def test_earlier_mistakes(weights):
    assert not [(t, spans(t, weights)) for t in CLEAN[:14] if spans(t, weights)]
    # a number is found whole or not at all
    assert spans("052 12 34 56 78", weights) <= {("phone", "052 12 34 56 78")}
