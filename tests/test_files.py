"""Digests of files of any size, and which files a manifest lists."""

import hashlib
import os
import subprocess
import sys

from floodspark.session import scratch_path
from floodspark.sinks import bands


def test_manifest_lists_all_but_its_own(spark):
    root = scratch_path(spark, "bundle").removeprefix("file:")
    for name, body in {"a.txt": b"one", "deep/b c.bin": b"\0" * 1000, "deep/manifest.json": b"{}", "manifest.json": b"own", "empty": b""}.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(body)
    got = {r["path"]: (r["bytes"], r["sha256"]) for r in bands.manifest(spark, root).collect()}
    want = {"a.txt": b"one", "deep/b c.bin": b"\0" * 1000, "deep/manifest.json": b"{}", "empty": b""}
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in want.items()}


def test_a_large_file_is_read_in_blocks(tmp_path):
    path = tmp_path / "large"
    with open(path, "wb") as f:
        f.truncate(3 << 30)  # three gigabytes, sparse on the disk
    code = ("import resource, sys; from floodspark.sinks.bands import file_digest; base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss;"
            "print(file_digest(sys.argv[1]), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base)")
    env = {**os.environ, "PYTHONPATH": os.pathsep.join(sys.path)}
    digest, grown = subprocess.run([sys.executable, "-c", code, f"file:{path}"], env=env, capture_output=True, text=True, check=True).stdout.split()
    want = hashlib.sha256()
    for _ in range(3 << 10):
        want.update(bytes(1 << 20))
    assert digest == want.hexdigest() and int(grown) < 200 << 10
