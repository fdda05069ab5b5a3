"""Configuration, checks, TypeScript output and watching."""

import pytest

from graphloom import kinds as K
from graphloom.__main__ import main
from graphloom.errors import LanguageNotImplemented
from graphloom.tooling import config, project


@pytest.fixture
def folder(tmp_path):
    assert main(["init", str(tmp_path)]) == 0
    (tmp_path / "schema/user.surql").write_text("DEFINE TABLE user; DEFINE FIELD name ON user TYPE string; DEFINE FIELD age ON user TYPE option<number>;")
    (tmp_path / "queries/get_user.surql").write_text("SELECT name, age FROM user")
    (tmp_path / "queries/add_user.surql").write_text("CREATE user CONTENT { name: $name }")
    return tmp_path


def test_run_writes_types(folder):
    assert main(["check", str(folder)]) == 0 and main(["run", str(folder)]) == 0
    text = (folder / "generated/queries.ts").read_text()
    assert "export const GetUserQuery = `SELECT name, age FROM user` as const;" in text
    assert "Array<Array<{ age: number | null; name: string; }>>" in text
    assert "export type AddUserVariables = { name: string; };" in text
    assert text.index("AddUserQuery") < text.index("GetUserQuery")


def test_found_from_a_folder_below(folder):
    (folder / "a/b").mkdir(parents=True)
    assert config.find(folder / "a/b").root == folder


def test_every_bad_query_is_named(folder, capsys):
    (folder / "queries/bad.surql").write_text("SELECT nope FROM user")
    (folder / "queries/worse.surql").write_text("SELECT * FROM nobody")
    assert main(["check", str(folder)]) == 1
    said = capsys.readouterr().err
    assert "bad.surql" in said and "worse.surql" in said


def test_inline_queries(folder):
    text = (folder / config.NAME).read_text().replace('path = "queries"', 'path = "queries"\nsrc = "src"')
    (folder / config.NAME).write_text(text)
    (folder / "src").mkdir()
    (folder / "src/app.ts").write_text("const q = surql(`SELECT VALUE name FROM user`); db.query(surql('SELECT age FROM user'));")
    assert {q.text for q in project.collect(config.find(folder))} >= {"SELECT VALUE name FROM user", "SELECT age FROM user"}


def test_other_languages_and_missing_settings(folder):
    c = config.find(folder)
    c.language = "rust"
    with pytest.raises(LanguageNotImplemented):
        project.generate(c)
    (folder / config.NAME).write_text('version = "1"')
    with pytest.raises(config.ConfigError):
        config.find(folder)


def test_watch_goes_on_after_an_error(folder):
    said = []

    def report(line):
        said.append(line)
        (folder / "queries/bad.surql").write_text("SELECT nope FROM user") if len(said) == 1 else (folder / "queries/bad.surql").unlink(missing_ok=True)

    project.watch(config.find(folder), report, rounds=4, pause=0.01)
    assert said[0].startswith("wrote") and "nope" in said[1] and said[2].startswith("wrote")


def test_typescript_of_kinds():
    for kind, ts in {"record<user>": 'RecordId<"user">', "option<string>": "string | null", "datetime": "Date", "'a' | 'b'": '"a" | "b"', "bytes": "Uint8Array", "int": "any", "[string]": "Array<string>", "object": "Record<string, any>"}.items():
        assert K.to_typescript(K.parse_kind(kind)) == ts
    assert project.escape("a`${b}\\") == "a\\`\\${b}\\\\"
