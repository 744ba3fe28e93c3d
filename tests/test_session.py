"""The package reaches the workers of a session, wherever it was started."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_import_the_package_from_any_folder(tmp_path):
    script = textwrap.dedent(
        f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from shelfkin.session import build_session
        spark = build_session(**{{"spark.master": "local[2]", "spark.ui.enabled": "false"}})

        def found(batches):
            from shelfkin.functions import text
            for batch in batches:
                yield batch

        print("rows", spark.range(3).mapInArrow(found, "id long").count())
        """
    )
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300
    )
    assert "rows 3" in done.stdout, done.stderr[-2000:]
