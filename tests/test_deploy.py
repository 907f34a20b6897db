"""The driver may import the entry module by path from any directory: worker-side code must still load."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_worker_functions_load_without_package_on_path(tmp_path):
    script = tmp_path / "drive.py"
    script.write_text(textwrap.dedent(f"""
        import importlib.util
        from pyspark.sql import SparkSession
        spec = importlib.util.spec_from_file_location("entry", "{REPO}/__spark_entry__.py")
        E = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(E)
        from bootframe.plans.catalog import QUERIES
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        # all that run Python in workers, and what is registered beside the core
        core = ["boot_custom_pandas", "boot_ci_exact_cells"]
        for name in core + sorted(set(E.queries()) - set(QUERIES)):
            E.queries()[name](spark, "/root/testdata/sf0.001").collect()
        print("OK")
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=1200)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "OK" in out.stdout
