import json
import struct
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from packsight.operators import images, labels, pipeline, products, recognise, records, rules, search
from packsight.sources import readers, writers
from packsight.streaming.ingest import engine_costs, ingest


def stub(table):
    """An engine that reads from a table and fails for what isn't in it."""
    return lambda payload: [(t, c) for t, c in table[bytes(payload).decode()]]


def test_escalation_calls_each_tier_once_and_keeps_the_best(spark, tmp_path):
    free = stub({"good": [("a" * 50, 0.9)], "short": [("tiny", 0.9)], "blur": [("b" * 60, 0.2)]})
    vlm = stub({"short": [("c" * 45, None)], "blur": [("d" * 10, None)]})
    paid = stub({"blur": [("e" * 80, 0.99)]})
    registry = recognise.Registry([recognise.Engine("ocr", free), recognise.Engine("vlm", vlm), recognise.Engine("cloud", paid, 0.0015, True)])
    written = []

    def store(df, name):
        path = f"{tmp_path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        written.append((name, spark.read.parquet(path).count()))
        return spark.read.parquet(path)

    rows = spark.createDataFrame([("k1", b"good"), ("k2", b"short"), ("k3", b"blur"), ("k3", b"blur"), ("k4", b"bad")], "key string, payload binary")
    got = {r.key: r for r in recognise.Ladder(registry, recognise.Policy(), store).read(rows).collect()}
    assert {k: r.engine for k, r in got.items()} == {"k1": "ocr", "k2": "vlm", "k3": "ocr", "k4": "ocr"}
    assert written == [("ocr", 4), ("vlm", 3)] and got["k4"].reason == "no text" and got["k3"].reason == "low confidence"
    written.clear()
    got = {r.key: r for r in recognise.Ladder(registry, recognise.Policy(allow_paid=True, budget_usd=0.003), store).read(rows).collect()}
    assert got["k3"].engine == "cloud" and got["k3"].cost_usd == 0.0015 and written[-1] == ("cloud", 2)
    union = {r.key: r for r in recognise.Ladder(registry, recognise.Policy(union_free=True), store).read(rows).collect()}
    assert union["k2"].engine == "ocr+vlm" and len(union["k2"].lines) == 2 and union["k2"].cost_usd == 0.0
    dual = {r.key: r for r in recognise.Ladder(registry, recognise.Policy(), store).read_dual(rows).collect()}
    assert dual["k2"].text_lines[0].text == "c" * 45 and dual["k1"].text_lines[0].text == "a" * 50


def test_cached_reads_cost_nothing_and_failed_ones_are_tried_again(spark, tmp_path):
    engine = recognise.Engine("ocr", stub({"x": [("n" * 50, 0.9)], "y": [("m" * 50, 0.9)]}), 0.5)
    cache = spark.createDataFrame([("a", "ocr", [("old" * 20, 0.9, None)], 0.5, False), ("b", "ocr", [], 0.0, True)], recognise.CACHE)
    rows = spark.createDataFrame([("a", b"x"), ("b", b"y")], "key string, payload binary")
    seen = []

    def store(df, name):
        df.write.parquet(path := f"{tmp_path}/s{len(seen)}")
        seen.append(spark.read.parquet(path).count())
        return spark.read.parquet(path)

    got = {r.key: r for r in recognise.Ladder(recognise.Registry([engine]), recognise.Policy(), store).read(rows, cache).collect()}
    assert got["a"].cached and got["a"].cost_usd == 0.0 and not got["b"].cached and seen == [1]


def test_expensive_expression_runs_once_a_key(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    out = recognise.dedupe_then_apply(rows, "k", "v", lambda v: v * 10, "w")
    assert sorted((r.k, r.w) for r in out.collect()) == [("a", 10), ("a", 10), ("b", 20)]


def test_content_key_has_the_shape(spark):
    row = spark.sql("select X'010203' as p, 1 as h, 3 as w").select(recognise.content_key(F.col("p"), F.col("h"), F.col("w")).alias("a"), recognise.content_key(F.col("p"), F.col("w"), F.col("h")).alias("b")).first()
    assert row.a != row.b


def test_results_do_not_depend_on_partitions(spark):
    from compare import DATA

    from packsight.plans import samples

    lines = samples.label_lines(spark, DATA)
    one, eight = (sorted(rules.extract_fields(lines.repartition(n)).collect()) for n in (1, 8))
    assert one == eight


def test_record_has_all_fields_in_order(spark):
    fields = spark.createDataFrame([("p", "Net Quantity", "330 ml", 0.9, "t")], "product_key string, field string, value string, confidence double, source string")
    row = records.records(fields).select(writers.record_json(F.col("record")).alias("j")).first()
    found = json.loads(row.j)
    assert tuple(found) == records.RECORD and len(found) == 37
    assert found["Net_Quantity"] == 330 and found["UOM"] == "ml" and found["Images"] == [] and found["Brand"] is None
    assert fields.groupBy().count().first()[0] == 1


def test_training_examples_leave_out_unlabelled_crops(spark):
    rows = spark.createDataFrame([("a", 1, 0, 0, "x", [0, 0, 1, 1], 0), ("a", 1, 0, 1, "y", [1, 0, 2, 1], 3), ("a", 2, 0, 0, "v", [1, 0, 2, 1], 3), ("a", 1, 1, 0, "w", [1, 0, 2, 1], 0), ("b", 1, 0, 0, "z", [0, 0, 1, 1], 0)], "product_key string, view int, crop int, word_no int, word string, box array<int>, label_id int")
    got = labels.training_examples(rows).collect()
    assert sorted((r.product_key, r.view, r.crop, r.words, r.label_ids) for r in got) == [("a", 1, 0, ["x", "y"], [0, 3]), ("a", 2, 0, ["v"], [3])]


def test_group_names(spark):
    rows = spark.createDataFrame([("x/Image_2_89.0.jpg",), ("image_1_89.0.JPG",), ("other.png",)], "path string")
    got = products.group_images(rows).collect()
    assert [(r.product_key, r.images) for r in got] == [("89.0", ["image_1_89.0.JPG", "x/Image_2_89.0.jpg"])]


def test_catalog_csv_keeps_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Upc / Ean,Front Filename,Back Filename\n0123.0,a.jpg,\n"4,5",,b.jpg\n')
    rows = readers.catalog_csv(spark, str(tmp_path / "t.csv"))
    assert [r["Upc / Ean"] for r in rows.orderBy("row_id").collect()] == ["0123.0", "4,5"]
    assert [(r.position, r.name) for r in products.listed_names(rows).orderBy("row_id").collect()] == [(0, "a.jpg"), (1, "b.jpg")]


def test_declared_schema():
    schema = readers.declared_schema('{"fields": [{"name": "A", "type": "boolean", "required": true}, {"name": "B", "type": "number"}]}')
    assert schema.simpleString() == "struct<A:boolean,B:double>" and not schema["A"].nullable


def test_sinks(spark, tmp_path):
    fields = spark.createDataFrame([("p", "Brand", "B", 0.9, "t")], "product_key string, field string, value string, confidence double, source string")
    writers.write_records(records.records(fields), f"{tmp_path}/records")
    assert spark.read.text(f"{tmp_path}/records").count() == 1
    lines = spark.createDataFrame([("p", "i1", 0, "a"), ("p", "i1", 1, "b"), ("p", "i2", 0, "c")], "product_key string, image string, line_no int, text string")
    assert writers.product_texts(lines).first().value == "=== i1 ===\na\nb\n\n=== i2 ===\nc"
    writers.write_texts(lines, f"{tmp_path}/texts")
    writers.write_report(lines, f"{tmp_path}/report", "test")
    assert spark.read.parquet(f"{tmp_path}/report").first().command == "test"


def test_stream_fills_the_cache_once(spark, tmp_path):
    source, cache, review = (str(tmp_path / n) for n in ("in", "cache", "review"))
    engine = recognise.Engine("ocr", lambda p: [(bytes(p).decode(), 0.5 if bytes(p) == b"weak" else 0.9)])
    for k, rows in enumerate(([("a", b"one"), ("b", b"weak")], [("a", b"one"), ("c", b"three")])):
        spark.createDataFrame(rows, "key string, payload binary").write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, payload binary").parquet(source)
        ingest(stream, engine, cache, str(tmp_path / "state"), review).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(cache).collect()) == ["a", "b", "c"]
    assert {r.key for r in spark.read.parquet(review).collect()} == {"b"}


def test_stream_costs_by_window(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 'ocr' as engine, 0.5D as cost_usd").write.parquet(f"{tmp_path}/calls")
    stream = spark.readStream.schema("ts timestamp, engine string, cost_usd double").parquet(f"{tmp_path}/calls")
    q = engine_costs(stream).writeStream.format("memory").queryName("costs").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("costs").first().cost_usd == 0.5


def scene():
    rgb = np.full((300, 400, 3), 240, dtype=np.uint8)
    rgb[60:240, 40:160] = (200, 30, 30)
    rgb[80:230, 220:340] = (20, 60, 160)
    return rgb


def test_stage_zero_finds_both_packs():
    mask, reason = images.segment(scene())
    assert reason == "backdrop" and images.crop_box(mask) is not None
    boxes = images.instance_boxes(mask)
    assert len(boxes) == 2 and boxes[0][0] < 60 and boxes[1][0] > 180
    crops, before, notes = images.prepare(scene(), images.Steps(low=200))
    assert len(crops) == 2 and before.shape == (300, 400, 3) and notes[-1] == "2 crops"


def test_uniform_image_is_kept_whole():
    flat = np.full((50, 60, 3), 128, dtype=np.uint8)
    assert images.segment(flat)[0].all() and images.instance_boxes(np.zeros((50, 60), bool)) == [(0, 0, 60, 50)]


def test_geometry_of_images():
    assert images.resized(scene(), 2).shape == (600, 800, 3) and images.resized(scene(), 0.5).shape == (150, 200, 3)
    assert images.rotate(scene(), 90).shape == (400, 300, 3)
    tilted = np.zeros((200, 200), bool)
    yy, xx = np.mgrid[:200, :200]
    a = np.deg2rad(8)
    tilted[(abs((xx - 100) * np.cos(a) + (yy - 100) * np.sin(a)) < 60) & (abs(-(xx - 100) * np.sin(a) + (yy - 100) * np.cos(a)) < 30)] = True
    assert abs(abs(images.skew_angle(tilted)) - 8) < 1
    ring = np.zeros((20, 20), bool)
    ring[5, 5:15] = ring[14, 5:15] = ring[5:15, 5] = ring[5:15, 14] = True
    assert images.fill_outlines(ring).sum() == 100
    assert sorted(c[4] for c in images.components(np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0], [0, 1, 0]], bool))) == [1, 5]
    assert images.crop_region(scene(), [(50, 50), (90, 70)]).shape == (50, 70, 3) and images.crop_region(scene(), []) is None


def test_exif_and_orientation():
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHIHH", 274, 3, 1, 6, 0)
    block = b"Exif\0\0" + tiff
    assert images.exif_orientation(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block) == 6
    assert images.exif_orientation(b"\xff\xd8\xff\xda") == 1 and images.exif_orientation(b"") == 1
    assert images.oriented(np.zeros((2, 3, 3), np.uint8), 6).shape == (3, 2, 3)


def test_decode_ladder_gates_by_checksum():
    calls = []

    def decode(image):
        calls.append(image.shape)
        return "bad" if len(calls) == 1 else "good"

    assert images.decode_ladder(scene(), decode, lambda c: c == "good")[1] == "direct x2 turned 0"
    assert images.decode_ladder(np.zeros((40, 40, 3), np.uint8), lambda i: None, lambda c: True) is None


def test_image_source_to_crops(spark, tmp_path):
    rgb = scene()
    (tmp_path / "Image_1_5.0.png").write_bytes(png_of(rgb))
    pixels = readers.image_pixels(spark, str(tmp_path))
    report = readers.format_report(pixels, readers.image_listing(spark, str(tmp_path), "*.png")).first()
    assert (report.width, report.height, report.channels) == (400, 300, 3)
    row = pixels.select("image.*").first()
    assert (images.rgb_of(bytes(row.data), row.height, row.width, row.nChannels) == rgb).all()
    crops = images.prepare_images(pixels, images.Steps(low=200)).collect()
    assert len(crops) == 2 and len({c.key for c in crops}) == 2


@pytest.mark.parametrize("channels", [1, 4])
def test_transparency_is_laid_on_white(channels):
    data = bytes([0]) if channels == 1 else bytes([10, 20, 30, 0])
    assert images.rgb_of(data, 1, 1, channels).tolist() == ([[[0, 0, 0]]] if channels == 1 else [[[255, 255, 255]]])


def test_barcode_validation_and_modes(spark):
    from packsight.operators import pipeline

    reads = spark.createDataFrame([("p", 1, None, "x\n8901414001626", "Acme", "tea"), ("q", 1, None, "901052034178", None, None)], "product_key string, view int, decoded string, text string, ocr_brand string, ocr_name string")
    one = spark.createDataFrame([("8901414001626", None, None)], "code string, name string, brand string")
    two = spark.createDataFrame([("8901414001626", "Green tea", "Acme")], "code string, name string, brand string")
    got = {r.product_key: r for r in pipeline.validate_barcodes(reads, one, two).collect()}
    assert got["p"].lookup_source == "secondary" and got["p"].brand_match == 1.0 and got["p"].text_match_ok and len(got["p"].trail) == 5
    assert got["q"].code is None and got["q"].unverified == "8901052034178"
    lines = spark.createDataFrame([("p", 0, "MRP Rs. 75", 0.9, 0.1)], "product_key string, line_no int, text string, confidence double, height double")
    words = spark.createDataFrame([("p", 1, 0, 0, "99", "MRP", 0.5), ("p", 1, 0, 1, "Acme", "BRAND", 0.9)], "product_key string, view int, crop int, word_no int, word string, label string, confidence double")
    value = lambda mode: {r.field: r.value for r in pipeline.extract_products(lines, labelled_words=words, mode=mode)[0].collect()}
    assert value("heuristic")["Mrp"] == "75" and value("model") == {"Mrp": "99", "Brand": "Acme"} and value("merged")["Mrp"] == "75" and value("merged")["Brand"] == "Acme"


def test_samples_and_ranges(spark):
    from packsight.operators import pipeline

    rows = spark.range(100).withColumnRenamed("id", "row_id")
    a, b = (sorted(r.row_id for r in pipeline.seeded_sample(rows.repartition(n), "row_id", 10, 7).collect()) for n in (1, 7))
    assert a == b and len(a) == 10
    assert pipeline.row_range(rows, 20, 5).count() == 5
    names = spark.createDataFrame([("Image_1.jpg",), ("other.jpg",)], "path string")
    assert pipeline.names_with(names, "IMAGE").count() == 1


def test_json_engine_retries_warmer():
    from packsight.operators.pipeline import json_engine

    seen = []

    def generate(payload, temperature):
        seen.append(temperature)
        if len(seen) == 1:
            raise OSError
        return "no object" if len(seen) == 2 else '```json\n{"a": 1, "b": 2, "c": 3, "d": "cu'

    assert json_engine(generate)("x") == {"a": 1, "b": 2, "c": 3} and seen == [0.2, 0.35, 0.5]
    assert json_engine(lambda p, t: "none")("x") is None


def test_pools_and_fetched_codes(spark, tmp_path):
    from packsight.operators import pipeline

    ocr = recognise.Engine("ocr", stub({"a": [("front", 0.9)], "b": [("back", 0.4)]}))
    vlm = recognise.Engine("vlm", stub({"a": [("FRONT LINE", None), (" ", None)]}))
    count = iter(range(99))

    def store(df, name):
        df.write.parquet(path := f"{tmp_path}/{name}{next(count)}")
        return spark.read.parquet(path)

    ladder = recognise.Ladder(recognise.Registry([ocr, vlm]), recognise.Policy(), store)
    crops = spark.createDataFrame([("p", 1, 0, "k1", b"a"), ("p", 2, 0, "k2", b"b"), ("q", 1, 0, "k1", b"a")], "product_key string, view int, crop int, key string, payload binary")
    text, layout, union = pipeline.collect_pools(crops, ladder)
    assert {r.product_key: r.text for r in union.collect()} == {"p": "FRONT LINE\nback", "q": "FRONT LINE"}
    assert sorted(r.text for r in layout.collect()) == ["back", "front", "front"]
    lines = pipeline.read_crops(crops.withColumn("arm", F.lit("raw")), ladder)
    assert lines.where("product_key = 'p'").count() == 3 and "arm" in lines.columns

    def fetch(code):
        if code == "down":
            raise OSError
        return {"name": "N", "brand": "B"} if code == "known" else None

    codes = spark.createDataFrame([("known",), ("known",), ("unknown",), ("down",), (None,)], "code string")
    assert sorted(map(tuple, pipeline.fetch_codes(codes, fetch).collect()), key=str) == [("known", "N", "B"), ("unknown", None, None)]


def test_two_paid_engines_share_a_budget(spark, tmp_path):
    def store(df, name):
        df.write.parquet(path := f"{tmp_path}/{name}-{uuid.uuid4().hex}")
        return spark.read.parquet(path)

    blur = stub({"blur": [("z" * 50, 0.1)]})
    engines = [recognise.Engine("ocr", blur), recognise.Engine("one", blur, 0.01, True), recognise.Engine("two", blur, 0.01, True)]
    rows = spark.createDataFrame([(f"k{k}", b"blur") for k in range(5)], "key string, payload binary")
    calls = []
    policy = recognise.Policy(allow_paid=True, budget_usd=0.03)
    recognise.Ladder(recognise.Registry(engines), policy, lambda df, name: (calls.append((name, (kept := store(df, name)).count())), kept)[1]).read(rows).count()
    assert calls == [("ocr", 5), ("one", 3), ("two", 0)]


def test_upright_photos_and_pictures_before_cropping(spark):
    exif = b"\xff\xd8\xff\xe1" + (6 + 8 + 2 + 12 + 2).to_bytes(2, "big") + b"Exif\0\0" + b"II*\0" + (8).to_bytes(4, "little") + (1).to_bytes(2, "little") + (274).to_bytes(2, "little") + (3).to_bytes(2, "little") + (1).to_bytes(4, "little") + (6).to_bytes(4, "little")
    rgb = scene()
    pixels = [("x", *rgb.shape[:2], 3, 16, rgb[:, :, ::-1].tobytes())]
    rows = spark.createDataFrame([(pixels[0], exif)], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>, content binary")
    steps = images.Steps(deskew=False, contrast=False, resolution=False)
    got = {r.crop: r for r in images.prepare_images(rows, steps, uncropped=True).collect()}
    assert (got[-1].height, got[-1].width) == (rgb.shape[1], rgb.shape[0]) and got[-1].notes[0] == "orientation 6" and len(got) >= 2


def test_decoded_images_are_cached_with_their_misses(spark):
    blank = np.full((40, 40, 3), 255, np.uint8)
    rows = spark.createDataFrame([(k, 40, 40, blank.tobytes()) for k in ("a", "b", "b", "c")], "key string, height int, width int, data binary")
    cache = spark.createDataFrame([("a", None, None)], "key string, code string, step string")
    got = {r.key: (r.code, r.step, r.cached) for r in images.decode_images(rows, lambda x: "123", lambda c: c == "123", cache).collect()}
    assert got == {"a": (None, None, True), "b": ("123", "direct", False), "c": ("123", "direct", False)}


def test_a_rate_limit_is_waited_for():
    asked, waited = [], []

    def generate(payload, warmth):
        asked.append(warmth)
        if len(asked) < 3:
            raise RuntimeError("limit")
        return '{"a": 1}'

    run = pipeline.json_engine(pipeline.patient(generate, lambda e: "limit" in str(e), waited.append))
    assert run(None) == {"a": 1} and len(set(asked)) == 1 and waited == [0, 1]


def test_passages_in_blocks(spark):
    docs = spark.createDataFrame([(1, "The  red fox jumps over it"), (2, "nothing"), (3, None)], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "red fox jumps high"), (2, "red dog sat high"), (3, ""), (4, None), (5, "ox")], "item_id long, text string")
    for block in (1, 100):
        assert sorted((r.doc_id, r.item_id) for r in search.passages_found(docs, passages, block).collect()) == [(1, 1), (1, 5)]
    assert search.passages_found(docs, passages.limit(0)).count() == 0
    assert [(r.doc_id, r.item_id, r.f1) for r in search.closest_passage(docs, passages).collect()] == [(1, 1, 0.6)]


def png_of(rgb):
    import zlib

    raw = b"".join(b"\0" + row.tobytes() for row in rgb)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_products_from_pictures(spark, tmp_path):
    rows = []
    for name in ("Image_1_5.0.jpg", "Image_2_5.0.jpg", "other.jpg"):
        rgb = scene()
        rows.append(((name, *rgb.shape[:2], 3, 16, rgb[:, :, ::-1].tobytes()),))
    pixels = spark.createDataFrame(rows, "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")

    def store(df, name):
        df.write.parquet(path := f"{tmp_path}/{name}-{uuid.uuid4().hex}")
        return spark.read.parquet(path)

    steps = images.Steps(deskew=False, contrast=False, resolution=False)
    pictures = store(images.prepare_images(pixels, steps, uncropped=True), "pictures")

    def read(payload):
        return [("Acme", 0.9, [(0, 0), (50, 0), (50, payload["height"] // 2), (0, payload["height"] // 2)]), ("8901414001626", 0.8)]

    ladder = recognise.Ladder(recognise.Registry([recognise.Engine("ocr", read)]), recognise.Policy(), store)
    known = spark.createDataFrame([("8901414001626", "Tea", "Acme")], "code string, name string, brand string")
    decode = lambda image: "8901414001626" if image.shape == (300, 400, 3) else None
    text, layout, texts, codes = pipeline.collect_products(pictures, ladder, decode, known, known.limit(0))
    one = codes.collect()
    assert [(r.product_key, r.view, r.source, r.code, r.canonical_brand, r.canonical_name) for r in one] == [("5.0", 1, "bars", "8901414001626", "Acme", "Tea")]
    heights = {(r.text, round(r.height, 1)) for r in layout.collect()}
    assert heights == {("Acme", 0.5), ("8901414001626", 0.0)} and texts.count() == 1
    fields, _ = pipeline.extract_products(text, layout, codes)
    got = {r.field: r.value for r in fields.collect()}
    assert got["Brand"] == "Acme" and got["Upc / Ean"] == "8901414001626" and got["Product Name"] == "Tea"


def test_checksum_of_one_code():
    from packsight.functions import barcode

    assert barcode.is_valid("8901414001626") and not barcode.is_valid("8901414001627")
    assert not barcode.is_valid("92113800") and not barcode.is_valid("") and not barcode.is_valid("89014140016x6")


def test_mattes_are_cached_and_cut(spark):
    rgb = scene()
    made = []

    def matte(image):
        assert image.shape == (300, 400, 3)
        alpha = np.zeros(image.shape[:2], np.uint8)
        alpha[60:240, 40:160] = 200
        return alpha

    steps = images.Steps(deskew=False, contrast=False, resolution=False, crop=False, split=False)
    pixels = spark.createDataFrame([((name, 300, 400, 3, 16, rgb[:, :, ::-1].tobytes()),) for name in "ab"], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    whole = images.prepare_images(pixels, steps)
    first = images.matte_images(whole, matte).collect()
    assert len(first) == 1 and not first[0].cached and len(first[0].alpha) == 300 * 400
    cache = spark.createDataFrame([(first[0].key, first[0].alpha)], "key string, alpha binary")
    again = images.matte_images(whole, lambda image: made.append(1) or 1 / 0, cache)
    assert [r.cached for r in again.collect()] == [True]
    crops = images.cut_images(whole, again, images.Steps(split=False)).collect()
    assert [(r.height, r.width) for r in crops] == [(204, 144)] * 2 and "mask: matte" in crops[0].notes
    rest = images.cut_images(whole, cache.limit(0), images.Steps()).collect()
    assert len(rest) == 4 and "mask: backdrop" in rest[0].notes


def test_token_model_has_a_window(spark):
    rows = spark.createDataFrame([("p", 1, 0, 1, "b", [1]), ("p", 1, 0, 0, "a", [0]), ("p", 1, 0, 2, None, None), ("p", 2, 0, 0, "c", None), (None, 1, 0, 0, "d", [3])], "product_key string, view int, crop int, word_no int, word string, box array<int>")
    got = {(r.product_key, r.view, r.word_no): (r.word, r.label, r.confidence) for r in labels.classify(rows, lambda words, boxes: [("MRP", 0.5)]).collect()}
    assert got == {("p", 1, 0): ("a", "MRP", 0.5), ("p", 1, 1): ("b", "O", 0.0), ("p", 2, 0): ("c", "MRP", 0.5), (None, 1, 0): ("d", "MRP", 0.5)}
    assert labels.classify(rows.limit(0), lambda words, boxes: []).count() == 0


def test_weak_labels_broadcast_nothing(spark):
    """The wanted tokens of all products are as many as the products: neither side may be sent whole through the driver."""
    words = spark.createDataFrame([(1, 0, "Acme,"), (1, 1, "55.0"), (1, 2, "tea"), (1, 3, "--"), (2, 0, "acme"), (None, 0, "acme"), (3, 0, None), (3, 1, "acme55")], "product_key long, word_no int, word string")
    truth = spark.createDataFrame([(1, "Product Name", "ACME tea"), (1, "Brand", "acme"), (1, "Mrp", "55"), (3, "Mrp", "55.0"), (2, "Brand", None), (2, "Unknown", "acme")], "product_key long, field string, value string")
    got = labels.weak_labels(words, truth)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.product_key, r.word_no): (r.label, r.label_id) for r in got.collect()} == {(1, 0): ("BRAND", 1), (1, 1): ("MRP", 2), (1, 2): ("PRODUCT_NAME", 7), (1, 3): ("O", 0), (2, 0): ("O", 0), (None, 0): ("O", 0), (3, 0): ("O", 0), (3, 1): ("MRP", 2)}


def test_gates_of_rules(spark):
    """A line is searched for a rule only if it can match, and then gives what the bare search gives."""
    texts = ["M.R.P. Rs 5", "MAXIMUM  RETAIL PRICE 12.50", "inr 7", "₹ 9", "NET WT: 5 KG", "3 L", "Lic. No. 10012345678901", "LICENSE NO 10012345678901", "FSSAI 10012345678901", "PKD packed by: Acme Foods, 1", "MADE IN new zealand", "Product  of INDIA", "Origin: peru", "PRESERVATIVE-FREE", "Preservatives:", "READY TO EAT", "readytocook", "AYURVEDIC", "FLAVOR: red mango", "Wild Berry flavour", "CAFFEINE 9 mg", "RECOMMENDED AGE 3+", "Weight 3 - 6 KG", "ABSORPTION 5 hrs", "2X3 CM", "2 × 3 mm", "PACK OF 6", "NON-VEG", "Vegetarian", "DRY HAIR", "K kelvin 3 K", "", None, "İstanbul 5 g"]
    rows = [(k, 0, t, 0.5, 0.1) for k, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "product_key long, line_no int, text string, confidence double, height double")
    lowered, figure = F.lower("text"), F.rlike("text", F.lit("[0-9]"))
    pairs = [F.struct(rules.may_match(r, lowered, figure).alias("may"), rules.value_of(r, F.col("text")).alias("value")) for r in rules.CATALOG]
    found = [p for row in lines.select(F.array(*pairs).alias("p")).collect() for p in row.p]
    assert sum(p.value is not None for p in found) >= 30
    assert all(p.may for p in found if p.value is not None)
    assert all(r.marks or r.figure for r in rules.CATALOG)
    assert sum(bool(p.may) for p in found) < len(found) / 3
