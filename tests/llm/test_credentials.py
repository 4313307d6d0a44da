import time

import pytest

from patchloom.llm import credentials
from patchloom.llm.credentials import MASK, find_credentials, masked, redact_credentials, spans

WORD = "quiet" + "-narrow-ledger"
HEX = "9f3a7c41" * 6
GH = "gh" + "p_" + "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3z"
SLACK = "xo" + "xb-12345678901-AbCdEfGhIjKlMnOpQrStUvWx"
LIVE = "qv" + "x_live_AbC123dEf456GhI789jKl012"
AWS = "AK" + "IA" + "NZ44GKQUMVKY6ZKM"
RANDOM = "aK9xPq27" + "ZmT4vB81cD"
PEM = ["-----BEGIN " + "RSA PRIVATE KEY-----", "MIIEpAIBAAKCAQEAx1Yc9dQ7", "b8Kq3LmN5pRs7TuV9wXy", "-----END " + "RSA PRIVATE KEY-----"]

FOUND = [
    (f'password = "{WORD}"', WORD), (f"  PASSWORD = '{WORD}';", WORD), (f"password: {WORD}", WORD), ("db_pass: somequietwords", "somequietwords"),
    (f'client = "{SLACK}"', SLACK), (f"# old: api key {GH} (rotate?)", GH), (f'X = "{LIVE}"', LIVE), (f"id={AWS}", AWS),
    (f'tok = "{GH[:9]}" + "{GH[9:]}";', None), (f"tok = '{GH[:2]}' + '{GH[2:]}'", None), (f"export DB_PASSWORD={RANDOM}", RANDOM),
    (f"run --rm -e STAGE_SECRET={RANDOM} image:1.2", RANDOM), (f"tool --token={RANDOM} --n 3", RANDOM), (f"tool --password {RANDOM} --n 3", RANDOM),
    (f"GET https://h.invalid/p?a=1&sig_key={RANDOM}", RANDOM), (f"dsn = 'redis://user:{RANDOM}@host.invalid:1/db'", RANDOM),
    (f"Server=h;User Id=u;Pwd={RANDOM};Timeout=3", RANDOM), (f"//h.invalid/:_authToken={RANDOM}", RANDOM), (f"Authorization: Basic {'dXNlcjpzcGFy' + 'cm93LWxhbXA='}", None),
    ("Authorization: Basic " + "cmluZzpBVmtWbWdlbnhY", None), ("passwd: " + "greedy.merger8475", "greedy.merger8475"), (f"h['Authorization'] = 'Bearer {RANDOM}'", RANDOM), (f"x.get(auth=('user', '{WORD}'))", WORD), (f"curl -s -u user:{RANDOM} https://h.invalid", RANDOM),
    (f"CREATE USER u IDENTIFIED BY '{WORD}';", WORD), (f"ALTER USER u WITH PASSWORD '{WORD}';", WORD), (f"machine h login u password {RANDOM}", RANDOM),
    (f"<secret>{RANDOM}</secret>", RANDOM), (f'p.setProperty("a.passwd", "{WORD}");', WORD), (rf'raw = "{{\"n\": 1, \"password\": \"{RANDOM}\"}}"', RANDOM),
    (f'  "clientSecret": "{RANDOM}",', RANDOM), (f'signing_key = b"{HEX}"', HEX), (f"aws_secret_access_key = {RANDOM}/+{RANDOM}", None),
    (f"-  token='{WORD}'", WORD), (f"  71 | f(x, token=\"{RANDOM}\")", RANDOM), (f"pem = '{PEM[0]}\\n{PEM[1]}\\n{PEM[2]}\\n{PEM[3]}'", None),
]
NONE = [
    'password = "changeme"', "secret = ''", "token = '[REDACTED]'", "password = '••••••••'", 'api_token = "xxxxxxxxxxxx"', "secret = '000000000000'", "password: ${DB_PASSWORD}",
    "password = os.environ['DB_PASSWORD']", "const token = process.env.API_TOKEN;", 'token = vault.read("a/b")', "password = getpass('db password: ')",
    "f(x, password=password, token=self.token)", "x.get(auth=(user.name, user.password))", "PASSWORD_FIELD = 'passwd'", "API_KEY_HEADER = 'X-Api-Key'", "max_tokens = 4096",
    "token_count = 5;", "# the password rule wants 12 characters and a token", "url = 'https://user:${PASS}@host.invalid/'", 'run -e API_TOKEN="$API_TOKEN" image',
    "CREATE USER u IDENTIFIED BY :db_password;", "content_hash = '" + HEX + "'", "commit " + HEX[:40], 'etag: W/"' + HEX[:32] + '"', '"integrity": "sha512-' + RANDOM * 4 + '=="',
    "request_id = '2d7a00d7-2119-45f8-a780-fc82aa1434a8'", "icon = 'data:image/png;base64," + RANDOM * 5 + "'", "ssh-rsa AAAA" + RANDOM * 3 + " u@h", "-----BEGIN PUBLIC KEY-----",
    "-----BEGIN CERTIFICATE-----", 'logger.warn("bad token in counter");', "password: string", "password: config.password", "Authorization: Basic <credentials>", "token: app.config2,", 'PASSWORD = "your-token-here"', "API_KEY = '<api-key>'", "", "\n",
]


@pytest.mark.parametrize(("line", "value"), FOUND)
def test_found(line, value):
    found = spans("x\n" + line + "\ny")
    assert found and all("\n" not in ("x\n" + line)[a:b] for a, b in found)
    if value:
        assert value in [("x\n" + line)[a:b] for a, b in found]


@pytest.mark.parametrize("line", NONE)
def test_not_found(line):
    assert spans(line) == [] and spans("+" + line) == []


def test_private_key_is_one_span_and_keeps_its_armor():
    text = "\n".join(["a", *PEM, "b"])
    (span,) = spans(text)
    out = masked(text, [span])
    assert text.count("\n") == out.count("\n") and PEM[0] in out and PEM[3] in out and PEM[1] not in out and PEM[2] not in out
    cut_off = "\n".join(PEM[:3])
    assert PEM[1] not in masked(cut_off, spans(cut_off))


def test_masks_only_the_value_and_is_stable():
    text = f'a = 1\npassword = "{WORD}"\nurl = "redis://u:{RANDOM}@h.invalid"\n'
    out = masked(text, spans(text))
    assert out == f'a = 1\npassword = "{MASK}"\nurl = "redis://u:{MASK}@h.invalid"\n' and spans(out) == []


def test_long_text_in_chunks(monkeypatch):
    monkeypatch.setattr(credentials, "CHUNK", 4000)
    monkeypatch.setattr(credentials, "OVERLAP", 1000)
    filler = "x = compute(value)\n" * 30
    text = "".join(f'{filler}password = "{WORD}{i}"\n' + ("\n".join(PEM) + "\n" if i % 7 == 0 else "") for i in range(60))
    chunked = spans(text)
    monkeypatch.setattr(credentials, "CHUNK", 1 << 30)
    assert chunked == spans(text) and len(chunked) == 69


RECORDS = "table_name string, record_key string, text string, line_no int"


def test_operator(spark, rows_of):
    text = f'x\r\npassword = "{WORD}"\r\ny\n\n  token = "{RANDOM}"'
    rows = [("t", "1", text, 0), ("t", "1", text, 0), ("t", "2", None, 0), ("t", "3", "", 0), ("t", "4", "clean\n" * 50_000, 0), ("t", None, f"password: {WORD}", 0)]
    df = spark.createDataFrame(rows, RECORDS)
    assert rows_of(find_credentials(df), "record_key", "line_no") == [(None, 1), ("1", 2), ("1", 5)]
    assert rows_of(redact_credentials(df), "record_key", "text") == [(None, f"password: {MASK}"), ("1", text.replace(WORD, MASK).replace(RANDOM, MASK))]
    assert find_credentials(df.limit(0)).count() == 0 and redact_credentials(df.limit(0)).count() == 0


def test_capitals_that_grow_when_lowered():
    text = "İ" * 50 + f'\npassword = "{WORD}"'
    assert [text[a:b] for a, b in spans(text)] == [WORD]


LINES = {
    "letters": "abcdefghij" * 100_000 + f' password = "{WORD}"',
    "names": "secret " * 150_000 + f'password = "{WORD}"',
    "pairs": "token=" * 170_000 + f'; password = "{WORD}"',
    "open quotes": "password='" * 1 + "secret=\"" * 1 + "token=`x " * 110_000 + f'password = "{WORD}"',
    "urls": "://a:b" * 170_000 + f' password = "{WORD}"',
    "blanks": "password" + " " * 1_000_000 + f'; password = "{WORD}"',
    "elements": "<password " * 100_000 + f'password = "{WORD}"',
    "begins": (PEM[0] + " ") * 30_000 + f'password = "{WORD}"',
    "encoded": RANDOM * 60_000 + f' password = "{WORD}"',
    "dots": "a.b-c_" * 170_000 + f'password = "{WORD}"',
}


@pytest.mark.parametrize("name", LINES)
def test_a_line_of_a_megabyte_is_read_in_linear_time(name):
    began = time.perf_counter()
    found = spans(LINES[name])
    assert time.perf_counter() - began < 5 and WORD in LINES[name][slice(*found[-1])]


def test_pass_phrases_of_any_length_and_sentences():
    phrase = " ".join(["copper", "lantern", "orbit", "velvet", "harbour", "mitten", "quartz", "saddle", "thimble", "walnut", "ember", "fjord"])
    assert [f'password = "{phrase}"'[a:b] for a, b in spans(f'password = "{phrase}"')] == [phrase]
    assert spans('password: "Please enter the password that you have been given by your administrator in the field"') == []


def test_tokens_of_few_characters_and_masked_ones():
    assert spans("gh" + "p_" + "ab1" * 12) and not spans("gh" + "p_" + "x" * 36) and not spans("AK" + "IA" + "X" * 16)


@pytest.mark.parametrize("lines", [300, 1500, 40_000])
def test_private_keys_of_any_length(lines):
    key = "\n".join([PEM[0], *["MIIEpAIBAAKCAQEAx1Yc9dQ7b8Kq3LmN5pRs7TuV9wXyMIIEpAIBAAKCAQEAx1Yc"] * lines, PEM[3]])
    text = f"a\n{key}\nb\n{PEM[0]}\n{PEM[1]}\nc"
    first, second = spans(text)
    assert text[slice(*first)] == key and text[slice(*second)] == f"{PEM[0]}\n{PEM[1]}"
    assert "MIIE" not in masked(text, [first, second])


def test_control_characters_stay(spark):
    text = f'\x01\x02a\x0f\n\x03password = "{WORD}"\x04'
    assert [text[a:b] for a, b in spans(text)] == [WORD] and masked(text, spans(text)) == text.replace(WORD, MASK)
