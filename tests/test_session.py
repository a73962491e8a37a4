import subprocess
import sys
from pathlib import Path


def test_executors_get_the_package(tmp_path):
    """Workers that cannot import the package from where they run are sent it."""
    top = Path(__file__).resolve().parents[1]
    code = f"""
import sys; sys.path.insert(0, {str(top)!r})
from tidemark.operators import buckets
from tidemark.session import session
s = session(spark__master="local[1]", spark__ui__enabled="false", spark__sql__shuffle__partitions="1")
df = s.createDataFrame([(1, "a", 1, 5)], "seq long, key string, klen long, vlen long")
assert [r.bytes for r in buckets.resetting(df, 500).collect()] == [54]
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_a_missing_library_takes_only_its_part_away(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(top)!r})
sys.modules["xxhash"] = None
import __spark_entry__ as e
assert len(e.queries()) > 50 and not any(k.startswith("op") and k[2].isdigit() for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
