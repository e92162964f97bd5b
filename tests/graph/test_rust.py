"""Rust: use trees, modules in crates, paths along them, names exported again, calls."""

import pytest
from evgraph.extract import rust_facts
from evgraph.operators import assemble, crates
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("tree", "names"),
    [
        ("a::b", [(["a", "b"], "b")]), ("a::b as c", [(["a", "b"], "c")]), ("a", [(["a"], "a")]), ("a::*", [(["a", "*"], "*")]),
        ("a::{b, c::{self, d as e}, f::*}", [(["a", "b"], "b"), (["a", "c"], "c"), (["a", "c", "d"], "e"), (["a", "f", "*"], "*")]),
        ("{a, b::c}", [(["a"], "a"), (["b", "c"], "c")]), ("::x::Y", [(["x", "Y"], "Y")]), ("a::{self as q}", [(["a"], "q")]), ("a::{}", []),
    ],
)
def test_use_trees(tree, names):
    assert rust_facts.leaves(tree) == names


SOURCE = '''\
//! use no::One;
use crate::db::{Repo, Kind as K};
/* use no::Two; */
pub use self::inner::Thing;
mod inner;
const S: &str = "use no::Three; fn no() {}";

pub struct Service<'a> { pub repo: Arc<Repo>, name: &'a str, kinds: Vec<K> }
struct Unit;
trait Saves { fn save(&self); }

impl<'a> Saves for Service<'a> {
    fn save(&self) { self.repo.write(); self.check(1); Self::make(); helper(); if (x) { K::new(); } }
}
fn helper() -> u8 { let q = 'x'; tools::mix(q) }
mod tests {
    use super::*;
    fn inside() { hidden(); }
    mod deep { use super::super::Other; }
}
'''


def test_facts_of_a_file():
    rows = rust_facts.facts_of("src/a.rs", SOURCE)
    of = lambda fact, *names: [tuple(r[n] for n in names) for r in rows if r["fact"] == fact]
    assert of("symbol", "qualified_name", "kind", "start_line") == [
        ("Service", "class", 8), ("Unit", "class", 9), ("Saves", "class", 10), ("Saves.save", "method", 10), ("Service.save", "method", 13), ("helper", "function", 15),
    ]
    assert of("import", "specifier", "kind", "tag", "detail", "start_line") == [
        ("crate.db", "use", "", "", 2), ("crate.db", "use", "", "", 2), ("self.inner", "use", "pub", "", 4), ("self.inner", "mod", "", "", 5),
        ("super", "use", "", "tests", 17), ("super.super", "use", "", "tests.deep", 19),
    ]
    assert of("field", "enclosing_class", "name", "type_name") == [("Service", "repo", "Repo"), ("Service", "name", "str"), ("Service", "kinds", "Vec")]
    assert of("call", "shape", "receiver", "name", "enclosing") == [
        ("self_field", "self.repo", "write", "Service.save"), ("self", "self", "check", "Service.save"), ("self", "Self", "make", "Service.save"),
        ("bare", "", "helper", "Service.save"), ("qualified", "K", "new", "Service.save"), ("qualified", "tools", "mix", "helper"),
    ]


def folder(spark, sources):
    rows = [(p, "rust" if p.endswith(".rs") else "", t.count("\n"), t) for p, t in sources.items()]
    return spark.createDataFrame(rows, "path string, lang string, line_count int, text string")


def test_places(spark):
    files = ["src/lib.rs", "src/main.rs", "src/a.rs", "src/a/b.rs", "src/c/mod.rs", "src/bin/x.rs", "src/bin/y/main.rs", "src/bin/y/z.rs", "crates/k/src/lib.rs", "src/gen/src/q.rs", "tests/t.rs", "build.rs", "x/src/w.rs"]
    known = spark.createDataFrame([("k", "crates/k"), ("root", "")], "crate string, dir string")
    got = {r.path: (r.tree, r.module) for r in crates.places(spark.createDataFrame([(f,) for f in files], "path string"), known).collect()}
    assert got == {
        "src/lib.rs": ("src", []), "src/main.rs": ("src", []), "src/a.rs": ("src", ["a"]), "src/a/b.rs": ("src", ["a", "b"]), "src/c/mod.rs": ("src", ["c"]),
        "src/bin/x.rs": ("src/bin/x", []), "src/bin/y/main.rs": ("src/bin/y", []), "src/bin/y/z.rs": ("src/bin/y", ["z"]), "crates/k/src/lib.rs": ("crates/k/src", []),
        "src/gen/src/q.rs": ("src", ["gen", "src", "q"]), "tests/t.rs": ("tests/t.rs", []), "build.rs": ("build.rs", []), "x/src/w.rs": ("x/src", ["w"]),
    }


BANK = {
    "core/Cargo.toml": '[package]\nname = "bank-core"\n[dependencies]\nserde = "1"\n',
    "core/src/lib.rs": "pub mod account;\npub mod rates;\npub use account::Account;\npub use crate::rates::*;\n",
    "core/src/account.rs": "use super::rates::Rate;\nuse serde::Serialize;\nuse std::fmt;\n\npub struct Account { rate: Rate }\nimpl Account {\n    pub fn grow(&self) { self.rate.apply(); self.log(); }\n    fn log(&self) {}\n}\n",
    "core/src/rates.rs": "pub struct Rate;\nimpl Rate { pub fn apply(&self) {} }\npub fn best() {}\nmod tests {\n    use super::*;\n    mod deep { use super::super::super::account; }\n}\n",
    "app/Cargo.toml": '[package]\nname = "app"\n',
    "app/src/main.rs": "use bank_core::{Account, Rate, best, missing};\nuse bank_core::rates::nothing;\nuse ghost::Spirit;\nmod ui;\n\nfn main() { ui::show(); best(); }\n",
    "app/src/ui.rs": "use super::*;\nuse bank_core::account::Account;\npub struct View { account: Account }\nimpl View {\n    pub fn paint(&self) { self.account.grow(); }\n}\npub fn show() {}\n",
    "app/Cargo.bad/Cargo.toml": "not [ toml",
}


def bank(spark):
    files = folder(spark, BANK)
    return files, rust_facts.extract(files)


def test_paths_find_modules_and_what_they_export_again(spark):
    files, facts = bank(spark)
    symbols = facts.filter("fact = 'symbol'")
    found, declared = crates.resolved(facts.filter("fact = 'import'"), files.filter("lang = 'rust'"), symbols, crates.packages(files))
    got = {(r.path, ".".join(r.parts)): r.target for r in found.collect()}
    lib, account, rates = (f"core/src/{n}.rs" for n in ("lib", "account", "rates"))
    assert got == {
        (lib, "self.account"): account, (lib, "self.rates"): rates, (lib, "account.Account"): account, (lib, "crate.rates"): rates,
        (account, "super.rates.Rate"): rates, (account, "serde.Serialize"): None, (account, "std.fmt"): None,
        (rates, "super"): rates, (rates, "super.super.super.account"): account,
        ("app/src/main.rs", "bank_core.Account"): lib, ("app/src/main.rs", "bank_core.Rate"): lib, ("app/src/main.rs", "bank_core.best"): lib,
        ("app/src/main.rs", "bank_core.missing"): None, ("app/src/main.rs", "bank_core.rates.nothing"): None, ("app/src/main.rs", "ghost.Spirit"): None,
        ("app/src/main.rs", "self.ui"): "app/src/ui.rs", ("app/src/ui.rs", "super"): "app/src/main.rs", ("app/src/ui.rs", "bank_core.account.Account"): account,
    }
    assert {r.name for r in declared.filter(F.col("file") == lib).collect()} == {"Account", "Rate", "best"}


def test_exports_in_a_circle_end(spark):
    sources = {
        "Cargo.toml": '[package]\nname = "loops"\n', "src/lib.rs": "mod a;\nmod b;\nmod c;\nuse a::Deep;\n",
        "src/a.rs": "pub use crate::b::*;\n", "src/b.rs": "pub use crate::c::*;\npub use crate::a::*;\n", "src/c.rs": "pub use crate::a::*;\npub struct Deep;\n",
    }
    files = folder(spark, sources)
    facts = rust_facts.extract(files)
    found, declared = crates.resolved(facts.filter("fact = 'import'"), files.filter("lang = 'rust'"), facts.filter("fact = 'symbol'"), crates.packages(files))
    assert {(r.file, r.name) for r in declared.collect()} == {(f"src/{n}.rs", "Deep") for n in "abc"}
    assert found.filter("base = 'a'").first().target == "src/a.rs"


def test_a_folder_becomes_the_graph_that_its_files_say(spark, tmp_path):
    for path, text in BANK.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = assemble.of_folder(spark, str(tmp_path))
    nodes = {r.id for r in got.nodes.collect()}
    assert len(nodes) == 5 + 10 and "core/src/account.rs#core.account.Account.grow" in nodes and "app/src/main.rs#app.main" in nodes
    edges = {(r.src.split("/")[-1], r.dst.split("/")[-1], r.kind) for r in got.edges.collect()}
    assert edges == {
        ("lib.rs", "account.rs", "imports"), ("lib.rs", "rates.rs", "imports"), ("account.rs", "rates.rs", "imports"), ("rates.rs", "account.rs", "imports"),
        ("main.rs", "lib.rs", "imports"), ("main.rs", "ui.rs", "imports"), ("ui.rs", "main.rs", "imports"), ("ui.rs", "account.rs", "imports"),
        ("account.rs#core.account.Account.grow", "rates.rs#core.rates.Rate.apply", "calls"), ("account.rs#core.account.Account.grow", "account.rs#core.account.Account.log", "calls"),
        ("main.rs#app.main", "ui.rs#app.ui.show", "calls"), ("ui.rs#app.ui.View.paint", "account.rs#core.account.Account.grow", "calls"), ("main.rs#app.main", "rates.rs#core.rates.best", "calls"),
    }
    cards = {(r.lang, r.kind): (r.resolved, r.external, r.unresolved) for r in got.scorecard().collect()}
    assert cards[("rust", "imports")] == (12, 2, 3)
