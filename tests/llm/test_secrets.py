import base64
import json
import random
import string

import pytest

from spanforge.llm import secrets

R = random.Random(3)


def rnd(n, a=string.ascii_letters + string.digits):
    return "".join(R.choice(a) for _ in range(n)) + "7Kq"


YES = [
    f"token = 'ghp_{rnd(36)}'", f"AKIA{rnd(13, string.ascii_uppercase).upper()}", f"curl -H 'Authorization: Bearer {rnd(40)}' https://x.test", "Authorization: Basic " + base64.b64encode(b"user:S3cretpw").decode(),
    f"DATABASE_URL=postgres://app:{rnd(12)}@pg.mill.test:5432/x", "password: 'Module*local857'", "DB_PASSWORD=idle-stream-836-qYGf", f"export ACCESSKEY={'0a' * 16}", f'os.environ["API_TOKEN"] = "{rnd(30)}"',
    f'x = "sk-ant-api03-{rnd(9)}" + "{rnd(30)}"', f"<db_pass>{rnd(12)}</db_pass>", f"mysql -h db.test -u app -p{rnd(11)} x < d.sql", f"sshpass -p '{rnd(9)}' ssh a@b.test", f"docker login -u w -p {rnd(13)} hub.test",
    f"curl -s -u w:{rnd(11)} https://h.test", f"machine h.test login w password {rnd(9)}", f"ENV API_KEY {rnd(20)}", f'variable "deploy_token" {{\n  default = "glpat-{rnd(20)}"\n}}', f"Server=h;User Id=s;Password={rnd(10)};Encrypt=true",
    f"https://h.test/f?access_token={rnd(30)}&v=2", "-----BEGIN RSA PRIVATE KEY-----\n" + rnd(60) + "\n" + rnd(60) + "\n-----END RSA PRIVATE KEY-----", f"eyJ{rnd(20)}.eyJ{rnd(20)}.{rnd(30)}",
]
NO = [
    "Authorization: Bearer ${API_TOKEN}", "Bearer <token>", "password: '********'", "PASSWORD_MIN_LENGTH = 12", "secretName: reviewer-tls", "token_count = 8247  # access_token budget", "export TOKEN=$(vault read -field=value kv/x)",
    "key = os.environ['API_KEY']", "passwd = getpass.getpass()", "deploy_token = load_secret('token/budget')", "api_key: ${{ secrets.API_KEY }}", "pwd: { type: string, minLength: 8 }", "SECRET=changeme-please", "KEY=your-api-key-here",
    "API_KEY=<YOUR_TOKEN>", "postgres://app:${DB_PASS}@h.test/x", "ssh-ed25519 AAAAC3NzaC1lZDI1NTE5AAAALmN8 b@r", "-----BEGIN PUBLIC KEY-----\n" + "A1b2" * 16 + "\n-----END PUBLIC KEY-----", "commit 96f691c5605ae72ba95de917c3aaadd5f92ae24b",
    "request_id=ee615a3e-cb1e-4c84-a2ba-1bf5f4498ad5", '"integrity": "sha512-' + "aB3" * 20 + '=="', "assert mask('ghp_****') == '[hidden]'", 'ETag: "ded621923d63c2e9443cf3e7522e4f0e"', "AKIA****************", "", "   ",
]


@pytest.mark.parametrize("text", YES)
def test_credentials(text):
    assert secrets.literals(text)


@pytest.mark.parametrize("text", NO)
def test_not_credentials(text):
    assert not secrets.literals(text)


def records(make_traces):
    one, two = f"ghp_{rnd(36)}", f"Step#narrow{R.randint(1000, 9999)}"
    placeholder = "Sample9Value"
    key = "-----BEGIN EC PRIVATE KEY-----\n+" + rnd(61) + "\n+" + rnd(61) + "\n+-----END EC PRIVATE KEY-----"
    rec = [
        {"row_id": 1, "task": {"repository": "r1"}, "steps": [{"tool_calls": [{"input": json.dumps({"command": f'echo "{one}"', "env": {"PASSWORD": two}})}, {"input": None}, None], "observations": [{"content": f"log {two} seen"}, {"content": ""}]}, None]},
        {"row_id": 2, "task": {"repository": "r2"}, "environment": {"vcs": {"diff": "@@ -1 +1,4 @@\n+" + key + "\n context"}}, "steps": [{"observations": [{"content": "nothing here"}]}]},
        {"row_id": 3},
    ]
    rec += [{"row_id": 10 + i, "task": {"repository": f"q{i}"}, "steps": [{"observations": [{"content": f"password = '{placeholder}'"}]}]} for i in range(secrets.SHARED_OWNERS)]
    return make_traces(rec), one, two


def test_found_index_and_rescan(make_traces):
    df, _, _ = records(make_traces)
    got = {tuple(r) for r in secrets.found(df).collect()}
    assert got == {(1, "input", "0.0"), (1, "observation", "0.0"), (2, "diff", "")}  # the bare repetition too, the shared placeholder not


def test_redaction_keeps_the_form(make_traces):
    df, one, two = records(make_traces)
    out = {(r.row_id, r.field): r.text for r in secrets.redacted(df).collect()}
    assert one not in out[(1, "input")] and two not in out[(1, "input")] and json.loads(out[(1, "input")])["env"]["PASSWORD"] == secrets.MARK
    lines = out[(2, "diff")].split("\n")
    assert len(lines) == 6 and lines[1] == "+-----BEGIN EC PRIVATE KEY-----" and lines[2].startswith("+") and lines[5] == " context"


def test_one_pass_for_many_secrets(make_traces, monkeypatch):
    """Every confirmed literal is found again where nothing gives it away, also with a filter that lets nearly all places pass."""
    many = [rnd(12 + i % 30) + str(i) for i in range(200)] + ["q7#é\"Z" + str(i) for i in range(5)]
    rec = [{"row_id": i, "steps": [{"observations": [{"content": f"password = '{w}'"}]}]} for i, w in enumerate(many)]
    rec += [{"row_id": 1000 + i, "steps": [{"tool_calls": [{"input": json.dumps({"a": f"see {w} there"})}]}]} for i, w in enumerate(many)]
    df = make_traces(rec)
    whole = {tuple(r) for r in secrets.found(df).collect()}
    confirmed = {i for i, f, _ in whole if f == "observation"}
    assert len(confirmed) >= 200 and {i - 1000 for i, f, _ in whole if f == "input"} == confirmed
    monkeypatch.setattr(secrets, "_slots", lambda v, n, which: (v % 3).astype("int64"))
    assert {tuple(r) for r in secrets.found(df).collect()} == whole


def test_the_end_of_a_very_long_literal(make_traces):
    long = rnd(600)
    df = make_traces([{"row_id": 1, "steps": [{"observations": [{"content": f"token = '{long}'"}]}]}, {"row_id": 2, "steps": [{"observations": [{"content": f"x {long} y"}, {"content": f"x {long[:300]} y"}]}]}])
    assert {tuple(r) for r in secrets.found(df).collect()} == {(1, "observation", "0.0"), (2, "observation", "0.0")}
    assert {r.text for r in secrets.redacted(df).where("row_id = 2").collect()} == {"x REDACTED y"}


def test_empty_invalid_and_long(make_traces):
    assert secrets.found(make_traces([])).count() == 0
    bad = f'{{"command": "x", "token": "ghp_{rnd(36)}"'
    long = "lorem ipsum 12 " * 70_000 + f" password='{rnd(14)}'"
    df = make_traces([{"row_id": 1, "steps": [{"tool_calls": [{"input": bad}], "observations": [{"content": long}]}]}, {"row_id": 1, "steps": [{"tool_calls": [{"input": bad}], "observations": [{"content": long}]}]}])
    assert {tuple(r) for r in secrets.found(df).collect()} == {(1, "input", "0.0"), (1, "observation", "0.0")}


def test_owners_and_short_literals(make_traces):
    again, strong_one, short = "Harbour*lantern41", rnd(20), "k7#Qz9"
    obs = lambda *t: [{"observations": [{"content": x} for x in t]}]
    rec = [{"row_id": i, "session_id": f"s{i}", "steps": obs(f"password = '{again}'")} for i in range(1, 13)]  # one record without repository, delivered often
    rec += [{"row_id": 20 + i, "task": {"repository": f"q{i}"}, "steps": obs(f"token = '{strong_one}'")} for i in range(12)]  # a random one is no placeholder, however widely shared
    rec += [{"row_id": 40, "task": {"repository": "r"}, "steps": obs(f"mysql -u app -p{short} x", f"saw {short} there", f"see ab{short}cd there")}]
    rec += [{"row_id": 50 + i, "session_id": f"t{i}", "steps": obs(f"run {i}: password = 'Sample9Value'")} for i in range(12)]  # different records share a placeholder
    df = make_traces(rec)
    want = {(i, "observation", "0.0") for i in [*range(1, 13), *range(20, 32), 40]} | {(40, "observation", "0.1")}
    assert {tuple(r) for r in secrets.found(df).collect()} == want
    assert {r.path: r.text for r in secrets.redacted(df).where("row_id = 40").collect()} == {"0.0": "mysql -u app -pREDACTED x", "0.1": "saw REDACTED there"}
