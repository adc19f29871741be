"""Syntax that the lexer reads, one test for each kind."""

import time

import pytest

from firstseen.llm import secret_scan

KEY = "Xk9fQ27vLm4Zt8Rw1"


def added(text):
    return [text[s:e] for s, e, _ in secret_scan.lexed_spans(text)]


def test_long_literals_and_names():
    long = KEY * 1000
    assert added(f'private_key = "{long}"') == [long]
    assert added(f'{"a" * 500}_private_key{" " * 300}= "{KEY}"') == [KEY]


@pytest.mark.parametrize("block", [
    r"-----BEGIN PRIVATE KEY-----\nMIIEvQIBADAN\n-----END PRIVATE KEY-----",
    "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\nMIIEvQIBADAN\n-----END RSA PRIVATE KEY-----"])
def test_private_keys(block):
    for text in (f'{{"private_key": "{block}"}}', f"private_key = '''{block}'''", f"private_key: |\n  {block}\n"):
        assert block in added(text)


def test_values_of_several_words():
    assert added('passphrase = "correct horse battery staple"') == ["correct horse battery staple"]
    assert added('title = "correct horse battery staple"') == []


def test_subscripts():
    assert added(f'config["db_credential"] = "{KEY}"') == [KEY]
    assert added(f"os.environ['DB_PASSWORD']='{KEY}'") == [KEY]
    assert added(f'credentials[0] = "{KEY}"') == [KEY]


@pytest.mark.parametrize("kind", ["str", "Optional[str]", "string | null", "Map<String, String>", "String?", "list[dict[str, str]]"])
def test_types(kind):
    assert added(f'db_credential: {kind} = "{KEY}"') == [KEY]
    assert added(f'title: {kind} = "{KEY}"') == []


def test_names_and_mixed_concatenations():
    assert added(f"BASE={KEY}\nDB_CREDENTIAL=$BASE") == [KEY]
    assert added(f'BASE={KEY}\nDB_CREDENTIAL="${{BASE}}"') == [KEY]
    assert added(f'BASE={KEY}\nDB_CREDENTIAL=${{BASE}}') == [KEY]
    assert added(f'part = "{KEY[:9]}"\ndb_credential = part + "{KEY[9:]}"') == [KEY[:9], KEY[9:]]
    assert added(f'part = "{KEY[9:]}"\ndb_credential = "{KEY[:9]}" + part') == [KEY[9:], KEY[:9]]


def test_time_is_linear():
    grown = 'a0 = "Xk9fQ27v"\n' + "".join(f"a{i + 1} = a{i} + a{i}\nsecret{i} = a{i}\n" for i in range(2000))
    for text in (grown, "a" * 300_000 + "=", '="' * 100_000, "a:" * 100_000, "x=-----BEGIN PRIVATE KEY " * 10_000, "k: [" * 50_000):
        began = time.time()
        secret_scan.lexed_spans(text)
        assert time.time() - began < 5


def test_padded_values_and_loose_frames():
    assert added(f"db_credential: {KEY}=") == [f"{KEY}="]
    text = 'private_key = "-----BEGIN PRIVATE KEY-----"\nprint("(x)")\nfooter = "-----END PRIVATE KEY-----"'
    assert added(text) == ["-----BEGIN PRIVATE KEY-----"]


@pytest.mark.parametrize("shape", [
    lambda n: "".join(f"k{i}=v{i}&" for i in range(n // 8)), lambda n: ("x" * 7 + "=") * (n // 8),
    lambda n: f"password{'=' * 3}a=" * (n // 14), lambda n: "a:" * (n // 2), lambda n: '{"k": ' * (n // 6),
    lambda n: "".join(f'password = "{KEY}{i}"\ntoken: {KEY}{i}\n' for i in range(n // 60)), lambda n: "token=" + "a&" * (n // 2),
    lambda n: 'a = "b" + ' * (n // 10), lambda n: 'a="""' * (n // 5), lambda n: "<a>" * (n // 3), lambda n: 'get("a",' * (n // 8)])
def test_time_doubles_with_the_text(shape):
    def seconds(text):
        began = time.process_time()
        secret_scan.spans(text)
        return time.process_time() - began

    half, whole = seconds(shape(500_000)), seconds(shape(1_000_000))
    assert whole <= 2.5 * half + 0.5 and whole < 10, (half, whole)


def test_form_data():
    assert added(f"user=me&db_credential={KEY}&page=2") == [KEY]
    assert added(f"DB_CREDENTIAL={KEY}&more") == [f"{KEY}&more"]
    assert added(f"x=1&db_credential={KEY}==&y=2") == [f"{KEY}=="]


@pytest.mark.parametrize("text", [
    f"db_credential = `{KEY}`", f'db_credential = f"{KEY}"', f"db_credential = rb'{KEY}'", f'db_credential = """{KEY}"""',
    f"db_credential = '''{KEY}'''", f'#define DB_CREDENTIAL "{KEY}"', f"<db_credential>{KEY}</db_credential>",
    f'x = os.getenv("DB_CREDENTIAL", "{KEY}")', f"os.environ.get('DB_CREDENTIAL', '{KEY}')", f'part = "{KEY}"\ndb_credential = f"{{x}}" + part',
])
def test_other_spellings_of_literals(text):
    assert KEY in added(text)
    assert added(text.replace("credential", "title").replace("CREDENTIAL", "TITLE")) == []


def test_added_spans_lie_in_no_base_span():
    text = "".join(f'api_key = "{KEY}{i}"; other_password_of = {KEY}{i}\n' for i in range(50))
    base, extra = secret_scan.spans(text)
    assert not [s for s in extra for b in base if b[0] <= s[0] and s[1] <= b[1]]
    assert set(extra) == {s for s in secret_scan.lexed_spans(text) if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)}
