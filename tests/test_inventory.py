"""Kept inventories of image folders against a walk of the same folders."""

import os

import pytest

from verdict.sources import inventory as inv


def walk(root):
    return sorted(os.path.join(d, f) for d, folders, files in os.walk(root) for f in files
                  if not any(p[0] in "._" for p in os.path.relpath(os.path.join(d, f), root).split("/")))


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}/"])
def test_listing_of_thousands_of_files(spark, scratch, form):
    root = os.path.join(scratch, "imgs")
    for i in range(40):
        folder = os.path.join(root, f"part {i % 7}", f"p{i}", *(["deep"] * (i % 3)))
        os.makedirs(folder)
        for j in range(60 if i else 700):
            with open(os.path.join(folder, f"{i}_{j}_claim.{('jpg', 'PNG', 'txt', 'JPeG')[j % 4]}"), "wb") as f:
                f.write(b"x" * (j % 5))
    os.makedirs(os.path.join(root, "empty"))
    os.makedirs(os.path.join(root, "_temporary"))
    for hidden in ("_temporary/a.jpg", ".b.jpg", "_SUCCESS"):
        open(os.path.join(root, hidden), "wb").close()
    files = inv.list_files(spark, form.format(root))
    got = {r.path.split("://")[-1]: r.size for r in files.collect()}
    assert sorted(got) == walk(root) and len(got) == 39 * 60 + 700
    assert all(size == os.path.getsize(p) for p, size in got.items())
    names = sorted(r.name for r in inv.images(files).collect())
    assert names == sorted(os.path.basename(p) for p in walk(root) if not p.endswith(".txt"))


def test_changes_between_inventories(spark, scratch):
    root, store = os.path.join(scratch, "imgs"), os.path.join(scratch, "store")
    os.makedirs(os.path.join(root, "a"))
    for n in ("a/1.jpg", "a/2.jpg", "3.jpg", "4.jpg"):
        with open(os.path.join(root, n), "wb") as f:
            f.write(b"x")
    assert inv.take_inventory(spark, root, store, "monday")
    assert not inv.take_inventory(spark, root, store, "monday")
    with open(os.path.join(root, "3.jpg"), "wb") as f:
        f.write(b"longer")
    os.utime(os.path.join(root, "4.jpg"), (1, 1))
    os.rename(os.path.join(root, "a/2.jpg"), os.path.join(root, "a/5.jpg"))
    assert inv.take_inventory(spark, root, store, "tuesday") and inv.take_inventory(spark, root, store, "wednesday")
    got = {(os.path.relpath(r.path, root), r.change) for r in inv.changes(spark, store, "monday", "tuesday").collect()}
    assert got == {("a/2.jpg", "removed"), ("a/5.jpg", "added"), ("3.jpg", "changed"), ("4.jpg", "changed")}
    assert inv.changes(spark, store, "tuesday", "wednesday").count() == 0
    assert inv.list_files(spark, os.path.join(scratch, "missing")).count() == 0
