"""``python -m lamella.cli VERB ROOT``: the store's questions asked of a bucket.

The master is that of spark-submit, or the local machine.
"""

from __future__ import annotations

import argparse
import functools
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import names
from lamella.operators import catalog, policy, reach
from lamella.session import session, written
from lamella.sources import objects, settings, sinks, transfer
from lamella.sources.bucket import Bucket
from lamella.sources.files import files


def expired_tags(bucket: Bucket, manifest: DataFrame, now: str, config: str) -> DataFrame:
    """(image, tag) behind the kept number and over the age of their rule; immutable images have none."""
    tags = manifest.where("image is not null and tag is not null").groupBy("image", "tag").agg(F.max("stored_at").alias("at"))
    rules = policy.effective(tags, bucket.rules(config)).where("not coalesce(immutable, false) and (keep_last is not null or max_age is not null)")
    return policy.retention_ranks(tags, rules, now).where("beyond and aged").select("image", "tag")


def clean_plan(bucket: Bucket, now: str, config: str = "config.yaml", cascade: bool = False) -> DataFrame:
    """(object_key, size_bytes, reason): keys of expired tags and of garbage.

    ``cascade`` counts what only expired tags keep as garbage too; without it, that
    shows in the next run. The plan is written before it is returned. ValueError if a
    manifest or a live recipe is missing or cannot be read or parsed: what it keeps alive
    is unknown.
    """
    manifest = bucket.manifest(strict=True)
    expired = written(expired_tags(bucket, manifest, now, config), "expired")
    listed = bucket.keys("manifests/")
    owner = listed.select("object_key", "size_bytes", F.regexp_extract("object_key", r"^manifests/(.+)/([^/]+)/(?:manifest\.json|signatures/[^/]+)\z", 1).alias("image"), F.regexp_extract("object_key", r"^manifests/(.+)/([^/]+)/(?:manifest\.json|signatures/[^/]+)\z", 2).alias("tag"))
    tags = owner.join(expired, ["image", "tag"], "left_semi").select("object_key", "size_bytes", F.lit("expired").alias("reason"))
    kept = catalog.current_tags(manifest)
    if cascade:
        kept = kept.join(expired, ["image", "tag"], "left_anti")
    recipe = written(bucket.recipe(), "recipes")
    live = written(reach.reachable(manifest, recipe, kept), "live")
    bucket.check_recipes(recipe, live)
    dead = reach.garbage(bucket.object_listing(), live, now).where("old_enough")
    keys = dead.select(F.concat_ws("/", "kind", F.lit("sha256"), "digest").alias("object_key"), "size_bytes", F.lit("garbage").alias("reason"))
    return written(tags.unionByName(keys), "plan")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lamella", description=__doc__)
    parser.add_argument("verb", choices=["list", "inspect", "stats", "classes", "sharing", "missing", "orphans", "doctor", "policy", "signatures", "clean", "cat", "delete", "config", "copy", "push", "pull"])
    parser.add_argument("root")
    parser.add_argument("rest", nargs="*", help="inspect, delete: image tag; cat: image tag path; config: key=value …; copy: target-root image tag [image tag]; push: source image tag; pull: image tag folder")
    parser.add_argument("--scope", default="", help="prefix of image names")
    parser.add_argument("--image", help="config: image pattern")
    parser.add_argument("--config", default="config.yaml")
    parser.add_argument("--platform", default="linux/amd64")
    parser.add_argument("--output", default="text", choices=["text", "json", "yaml"])
    parser.add_argument("--confirm", action="store_true", help="delete what a plan lists")
    parser.add_argument("--cascade", action="store_true")
    parser.add_argument("--deep", action="store_true", help="doctor: also chunks and recipes")
    parser.add_argument("--force", action="store_true", help="write or delete tags of immutable images")
    a = parser.parse_args(args)
    if "://" in a.root:
        # verbs about one tag take scheme://bucket/image:tag, the others scheme://bucket/scope
        if a.verb in ("inspect", "cat", "delete", "pull", "copy"):
            of_tag = names.parse_reference(a.root)
            if not of_tag.tag:
                parser.error(f"{a.root}: a tag is needed")
            a.root = names.root_uri(of_tag.scheme, of_tag.bucket)
            place = 1 if a.verb == "copy" else 0
            a.rest[place:place] = [of_tag.image, of_tag.tag]
        else:
            of_bucket = names.parse_bucket(a.root)
            a.root, a.scope = names.root_uri(of_bucket.scheme, of_bucket.bucket), a.scope or of_bucket.scope
    if a.verb == "config":
        import yaml

        held = objects.bucket_config(a.root, a.config)
        for pair in a.rest:
            key, _, value = pair.partition("=")
            held = settings.changed(held, key, value, a.image)
        if a.rest:
            files(a.root).write(a.config, yaml.safe_dump(held, sort_keys=True).encode())
        print(yaml.safe_dump(held, sort_keys=True), end="")
        return 0
    spark = session("lamella")
    bucket = Bucket(spark, a.root)
    now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")

    def chosen() -> DataFrame:
        """Layers of one tag, of the platform asked for if it is an index."""
        plain = catalog.plain_manifests(bucket.manifest())
        own = plain.where((F.col("image") == a.rest[0]) & (F.col("tag") == a.rest[1]))
        picked = catalog.pick_platform(own, a.platform).join(catalog.newest_manifests(plain).select("digest", F.col("manifest_id").alias("child")), "digest").select(F.col("child").alias("manifest_id"))
        ids = own.where(F.size("manifests") == 0).select("manifest_id").unionByName(picked)
        return catalog.layer_rows(plain.join(ids, "manifest_id", "left_semi")).orderBy("pos")

    if a.verb in ("copy", "push", "pull"):
        if a.verb == "copy":
            target, image, tag, *new = a.rest
            counts = transfer.copy_image(spark, a.root, target, image, tag, *new, platform=a.platform if "--platform" in (args or sys.argv) else None, force=a.force)
        elif a.verb == "push":
            source, image, tag = a.rest
            counts = transfer.push_image(spark, source, a.root, image, tag, config=a.config, force=a.force)
        else:
            image, tag, into = a.rest
            counts = transfer.pull_image(spark, a.root, image, tag, into, a.platform)
        print(sinks.render(spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} bigint" for k in counts)), a.output))
        return 0
    if a.verb == "cat":
        sys.stdout.buffer.write(bucket.cat([r["digest"] for r in chosen().collect()], a.rest[2]))
        return 0
    if a.verb in ("clean", "delete"):
        if a.verb == "clean":
            plan = clean_plan(bucket, now, a.config, a.cascade)
        else:
            image, tag = a.rest
            try:
                transfer.refuse_immutable(bucket, image, tag, a.config, a.force, existing=False)
            except PermissionError as e:
                print(e, file=sys.stderr)
                return 1
            plan = written(bucket.keys(f"manifests/{image}/{tag}/").select("object_key", "size_bytes", F.lit("deleted").alias("reason")), "plan")
        print(sinks.render(plan, a.output))
        sinks.delete_objects(plan, a.root, a.confirm)
        return 0
    manifest = functools.cache(bucket.manifest)
    made = {
        # names alone, also of the older layout; no manifest is read
        "list": lambda: catalog.images_of_keys(bucket.keys()).where(F.col("image").startswith(a.scope)).select("image", F.size("tags").alias("n_tags"), "tags").orderBy("image"),
        "inspect": lambda: bucket.inspect(*a.rest),
        "stats": lambda: catalog.summary(manifest().where(F.coalesce(F.col("image").startswith(a.scope), F.lit(True))), bucket.object_listing()),
        "classes": lambda: catalog.by_storage_class(bucket.object_listing()),
        "sharing": lambda: catalog.layer_sharing(manifest(), a.scope).orderBy(F.desc("n_tags"), F.desc("size_bytes"), "digest"),
        "missing": lambda: reach.missing(manifest(), bucket.object_listing()).orderBy("image", "tag"),
        "orphans": lambda: reach.orphans(manifest(), bucket.object_listing()).orderBy("kind", "digest"),
        "doctor": lambda: bucket.doctor(a.scope, a.config, a.deep).orderBy("check", "image", "tag", "detail"),
        "signatures": lambda: bucket.signatures().orderBy("image", "tag", "slug"),
        "policy": lambda: policy.effective(manifest(), bucket.rules(a.config)).orderBy("image"),
    }[a.verb]()
    print(sinks.render(made, a.output))
    return 0


if __name__ == "__main__":
    sys.exit(main())
