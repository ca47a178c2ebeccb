"""Repositories made by git, read by tasks, against what git says of them."""

import os
import random
import shutil
import subprocess
import tempfile

import pytest

from textloom.operators import history
from textloom.sources import git

pytestmark = pytest.mark.skipif(not shutil.which("git"), reason="needs git to make repositories")


def run(repo, *args, when=None):
    env = os.environ | {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "a@b", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    if when:
        env |= {"GIT_AUTHOR_DATE": f"{when} +0000", "GIT_COMMITTER_DATE": f"{when} +0000"}
    return subprocess.run(["git", "-C", repo, "-c", "protocol.file.allow=always", *args], check=True, capture_output=True, env=env).stdout


def put(repo, path, content):
    file = os.path.join(repo, path)
    os.makedirs(os.path.dirname(file), exist_ok=True)
    with open(file, "wb") as f:
        f.write(content)


@pytest.fixture(scope="module")
def repo():
    """Thirty commits: long deltas, folders, a binary, odd names, a merge, a tag object; half packed twice, the rest loose."""
    root, rnd = tempfile.mkdtemp(prefix="textloom-git-"), random.Random(3)
    run(root, "init", "-q", "-b", "main")
    lines = [f"line {i} {rnd.random()}\n" for i in range(3000)]
    for k in range(30):
        for _ in range(20):
            lines[rnd.randrange(len(lines))] = f"changed {k} {rnd.random()}\n"
        put(root, "src/long/file.txt", "".join(lines).encode())
        put(root, f"src/d{k % 4}/f{k % 7}.ts", f"export const x = {k}\n".encode())
        if k == 3:
            put(root, "b.bin", bytes(range(256)) * 50)
            put(root, "späce name.md", "größe\n".encode())
            put(root, "empty", b"")
            put(root, "latin", b"caf\xe9\n")
        if k == 9:
            run(root, "rm", "-q", "empty")
        if k == 12:
            run(root, "mv", "src/d0/f0.ts", "moved.ts")
        run(root, "add", "-A")
        run(root, "commit", "-q", "-m", f"{'fix' if k % 3 == 0 else 'add'} {k}\n\nbody\n\nmore", when=1700000000 + 60 * k)
        if k == 8:
            run(root, "branch", "side")
        if k == 14:
            run(root, "tag", "-a", "v1", "-m", "one", when=1700000000 + 60 * k)
            run(root, "gc", "-q", "--aggressive")
        if k == 20:
            run(root, "repack", "-q", "-d")
    run(root, "checkout", "-q", "side")
    put(root, "side.txt", b"side\n")
    run(root, "add", "-A")
    run(root, "commit", "-q", "-m", "side", when=1700010000)
    run(root, "checkout", "-q", "main")
    run(root, "merge", "-q", "--no-ff", "-m", "merge", "side", when=1700010060)
    return root


def wanted(repo, ref, under=""):
    names = [n for n in run(repo, "ls-tree", "-r", "-z", "--name-only", ref).decode().split("\0") if n and n.startswith(under)]
    return {n: run(repo, "show", f"{ref}:{n}") for n in names}


def test_every_object_is_as_git_has_it(spark, repo):
    at = git.index(spark, repo, per_part=37)
    got = {r.sha: (r.kind, bytes(r.content)) for r in git.objects(at, at).collect()}
    listed = [x.split() for x in run(repo, "cat-file", "--batch-check", "--batch-all-objects").decode().splitlines()]
    assert {s: k for s, k, _ in listed} == {s: k for s, (k, _) in got.items()} == {r.sha: r.kind for r in git.kinds(at).collect()}
    assert {k for k, _ in got.values()} == {"commit", "tree", "blob", "tag"}
    import hashlib

    assert all(hashlib.sha1(f"{k} {len(c)}\0".encode() + c).hexdigest() == s for s, (k, c) in got.items())
    packs = {r.file for r in at.collect() if r.offset >= 0}
    assert len(packs) >= 2 and at.filter("offset < 0").count() > 0


def test_snapshots(spark, repo):
    refs = ["main", "v1", "side", run(repo, "rev-parse", "HEAD~20").decode().strip()]
    got = {}
    for r in git.snapshot(spark, repo, refs + ["main"]).collect():
        assert (r.ref, r.path) not in got
        got[(r.ref, r.path)] = r.content, r.binary
    want = {(ref, p): (c.decode("utf-8", "replace"), b"\0" in c[:8000]) for ref in refs for p, c in wanted(repo, ref).items()}
    assert got == want and any(b for _, b in got.values())


def test_only_wanted_folders_are_read(spark, repo):
    for paths in (["src/d1"], ["src/d1/", "b.bin"], ["src/long/file.txt"], ["src/d"], ["b.bin/x"], [""], []):
        got = {r.path for r in git.files(spark, repo, ["HEAD"], paths).collect()}
        clean = [p.strip("/") for p in paths]
        assert got == {n for n in wanted(repo, "HEAD") if any(not p or n == p or n.startswith(p + "/") for p in clean)}, paths


def test_changes_and_history(spark, repo):
    raw = run(repo, "log", "--all", "--no-merges", "--no-renames", "--root", "--name-status", "-z", "--format=%x01%H").decode()
    want, names = set(), {"A": "added", "D": "deleted", "M": "modified"}
    for block in raw.split("\x01")[1:]:
        part = [x.strip("\n") for x in block.split("\0") if x.strip("\n")]
        want |= {(part[0], p, names[s]) for s, p in zip(part[1::2], part[2::2])}
    assert {(r.commit, r.path, r.status) for r in git.changes(spark, repo).collect()} == want
    log = git.log(spark, repo)
    asked = spark.createDataFrame([(repo, "src/long/file.txt"), (repo, "nowhere")], "repo string, path string")
    got = {r.path: r for r in history.history(asked, log).collect()}
    assert got["src/long/file.txt"].total_commits == 30 and got["nowhere"].reason == history.NO_HISTORY
    subjects = {r.sha: (r.subject, r.parents, r.author) for r in git.commits(git.index(spark, repo)).collect()}
    for line in run(repo, "log", "--all", "--format=%H%x01%s%x01%P%x01%an").decode().splitlines():
        sha, subject, parents, author = line.split("\x01")
        assert subjects[sha] == (subject, parents.split(), author)


def test_clones_and_errors(spark, repo):
    root = tempfile.mkdtemp(prefix="textloom-git-")
    run(root, "clone", "-q", "--bare", repo, f"{root}/bare.git")
    run(root, "clone", "-q", "--shared", repo, f"{root}/shared")
    run(root, "clone", "-q", "--depth", "2", f"file://{repo}", f"{root}/shallow")
    for clone in ("bare.git", "shared", "shallow"):
        got = {r.path: r.content for r in git.snapshot(spark, f"{root}/{clone}", ["HEAD"], ["src"]).collect()}
        assert got == {p: c.decode() for p, c in wanted(repo, "HEAD", "src/").items()}, clone
    assert git.changes(spark, f"{root}/shallow").count() > 0
    run(root, "init", "-q", f"{root}/none")
    assert git.index(spark, f"{root}/none").count() == 0 and git.changes(spark, f"{root}/none").count() == 0
    with pytest.raises(ValueError, match="unknown ref"):
        git.snapshot(spark, repo, ["nope"])
    with pytest.raises(FileNotFoundError, match="not a git repository"):
        git.resolve(root, "HEAD")
    with pytest.raises(Exception, match="missing object"):
        git.snapshot(spark, repo, ["0" * 40])
