import json

import pytest

from seamwright.__main__ import main
from seamwright.plans import config


def test_config(tmp_path):
    assert config.load(tmp_path).risk.breaking == 16
    (tmp_path / "seamwright.config.json").write_text(json.dumps({"version": "2.0", "client": "c", "services": {"a": {"criticality": "TIER_3_LOW"}}, "risk": {"baseWeightBreaking": 20, "thresholds": {"critical": 80}, "sensitiveFields": ["email"]}}))
    found = config.load(tmp_path)
    assert (found.client, found.risk.breaking, found.risk.levels, found.sensitive) == ("c", 20, (80, 50, 25), ("email",))
    (tmp_path / "seamwright.config.json").write_text('{"version": "1.0"}')
    with pytest.raises(ValueError):
        config.load(tmp_path)
    assert config.project_roots(tmp_path) is None
    for d in ("web", "api"):
        (tmp_path / d).mkdir()
    assert config.project_roots(tmp_path) == (str(tmp_path / "web"), str(tmp_path / "api"))


def test_check_and_impact(spark, tmp_path, capsys):
    for name, path, text in (("client", "a.ts", "const r = await axios.get<{ a: string }>('/u');\nshow(r.a);"), ("old", "s.ts", "router.get('/u', (req, res): R => { res.json({ a: 'x' }); });"), ("new", "s.ts", "router.get('/u', (req, res) => { res.json({ b: 'x' }); });")):
        (tmp_path / name).mkdir()
        (tmp_path / name / path).write_text(text)
    at = lambda n: str(tmp_path / n)
    assert main(["check", at("client"), at("old")], spark) == 0
    assert main(["check", at("client"), at("new"), "--format", "json", "--out", at("out.json")], spark) == 1
    assert [x["kind"] for x in json.loads((tmp_path / "out.json").read_text())] == ["missing-field"]
    capsys.readouterr()
    assert main(["impact", at("client"), at("old"), at("new")], spark) == 1
    assert json.loads(capsys.readouterr().out)["summary"]["breaking"] == 1


def test_intent_commands(spark, tmp_path, capsys):
    import subprocess

    from seamwright.plans import baseline

    server = "app.get('/u', (req, res) => {{ res.json({{ id: 1, {}: 'x' }}) }});"
    for name, path, text in (("client", "a.ts", "const r = await axios.get('/u');\nshow(r.mail);"), ("server", "s.ts", server.format("mail"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / path).write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first")
    (tmp_path / "server" / "s.ts").write_text(server.format("email"))
    at = lambda n: str(tmp_path / n)
    old = baseline.files_of(spark, "HEAD", at("server"), tmp_path).collect()
    assert [(r.path, r.lang) for r in old] == [("s.ts", "ts")] and "mail: 'x'" in old[0].text
    assert baseline.files_of(spark, "0000", at("server"), tmp_path).count() == baseline.files_of(spark, "EMPTY", at("server"), tmp_path).count() == 0
    with pytest.raises(ValueError):
        baseline.files_of(spark, "HEAD", "/", tmp_path)
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "s.ts").write_text(old[0].text)
    assert main(["validate", at("client"), at("server")], spark) == 0 and "valid" in capsys.readouterr().out
    places, stated = [at("client"), at("old"), at("server")], "--rename=contract:GET:/u.mail->contract:GET:/u.email"
    with pytest.raises(SystemExit):
        main(["fix", *places], spark)
    capsys.readouterr()
    assert main(["agent-check", *places, stated], spark) == 1
    told = json.loads(capsys.readouterr().out)
    assert told["status"] == told["verdict"] == "INCOMPLETE" and told["repair_available"] and stated in told["next_actions"][0]
    assert main(["fix", *places, stated], spark) == 0
    assert json.loads(capsys.readouterr().out)["verdict"] == "DRY_RUN" and "r.mail" in (tmp_path / "client" / "a.ts").read_text()
    assert main(["receipt", *places, stated, "--apply"], spark) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["verdict"] == "PROVEN" and [c["state"] for c in told["consumers"]] == ["fixed"] and "r.email" in (tmp_path / "client" / "a.ts").read_text()
