from test_sources import GENERIC

from tallyforge import types as T
from tallyforge.operators import convert
from tallyforge.sources import statements
from tallyforge.streaming import imports


def test_files_are_imported_once(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    (src / "a.csv").write_text(GENERIC)
    options = convert.Options("assets:bank", commodity="USD", batch_id="s")
    q = imports.import_stream(spark, f"file://{src}", out, statements.adapter("generic"), options)
    try:
        q.processAllAvailable()
        assert imports.stored(spark, f"{out}/transactions", T.TRANSACTION).count() == 4
        (src / "c.csv").write_text("Date,Description\n2026-01-01,x\n")
        (src / "b.csv").write_text(GENERIC + "2026-01-09,NEW SHOP,-1.00,USD,1\n")
        q.processAllAvailable()
    finally:
        q.stop()
    assert imports.stored(spark, f"{out}/transactions", T.TRANSACTION).count() == 5
    assert imports.stored(spark, f"{out}/statement_rows", T.STATEMENT_ROW).count() == 9
    failed = imports.stored(spark, f"{out}/{imports.FAILED}", imports.FAILED_ROW).collect()
    assert [(r.source_path[-5:], r.schema_error) for r in failed] == [("c.csv", "invalid schema: missing required column 'Amount' (have: Date, Description)")]
