import io
import struct
import zipfile

import numpy as np
import pytest

from fluxlode.sources import loaders, sinks

GENERIC = "'Date','Time','Latitude','Longitude','Mag','MagComp','MagValid','Altitude','GyroscopeX','GyroscopeY','GyroscopeZ','AccelerometerX','AccelerometerY'\n" + "\n".join(
    f"'2026-07-01','10:00:{s:02d}.5',{36 + s / 1000},127.0,{50000 + s},{49000 + s},{0 if s == 3 else 1},{'' if s == 2 else 100 + s},3,4,0,0.3,0.4" for s in range(6)
)
R1 = "Date,Time,Latitude,Longitude,Heading,Next WP,Altitude,Altitude AGL,TMI,Bx,By,Bz\n2026-07-01,11:00:00.0,36.1,127.1,0,1,50,30,50100.5,1,2,3\n2026-07-01,11:00:01.0,0,0,0,1,50,30,50101,1,2,3"
MICRO = "a,MagField_J1[uT],SeqNum,TOW,lat[deg],lon[deg],alt[m],Roll[s]\n0,50.25,1,3600.5,36.2,127.2,80,0"
RAW = "Date: 02.07.2026\nTime: 08:30:00\nnotes\nTimestamp [ms]; B1x [nT]; B1y [nT]; B1z [nT]; Latitude; Longitude; Altitude\n0; 3; 4; 12; 36.0; 127.0; 10\n1000; 3; 4; 12; 0; 0; 0\n2000; 3; 4; 12; 36.2; 127.2; 30"
ASC = "timestamp_ms sensor_id lat lon total_field_nt mag_x_nt mag_y_nt mag_z_nt\n1000 B 36.3 127.3 50000 1 2 3\n1000 A 36.3 127.3 50001 1 2 3\n2000 B 36.4 127.3 50002 1 2 3"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("survey")
    for name, text in (("a.csv", "﻿" + GENERIC), ("b.csv", R1), ("c.csv", MICRO), ("d.txt", RAW), ("e.asc", ASC), ("f.csv", GENERIC), ("g.csv", "nothing here")):
        (at / name).write_text(text)
    return str(at)


def test_survey_files_of_all_formats(spark, files):
    got = loaders.load_survey(spark, files, day="2026-07-05").orderBy("point_id").collect()
    assert [r.point_id for r in got] == list(range(len(got))) == list(range(5 + 1 + 1 + 3 + 2))
    first = [r for r in got if r.source_file_index == 0]
    assert [r.mag_raw for r in first] == [49000.0, 49001.0, 49002.0, 49004.0, 49005.0] and all(r.used_precompensated_mag for r in first)
    assert [r.altitude_msl_m for r in first] == pytest.approx([100, 101, 102.5 - 0.5, 104, 105], abs=0.51)
    assert first[0].gyro_mag == 5 and first[0].accel_horiz_g == pytest.approx(0.5)
    raw = [r for r in got if r.source_file_index == 3]
    assert [round(r.lat, 6) for r in raw] == [36.0, 36.1, 36.2] and raw[0].mag_raw == 13 and str(raw[1].timestamp) == "2026-07-02 08:30:01"
    micro = next(r for r in got if r.source_file_index == 2)
    assert micro.mag_raw == 50250 and str(micro.timestamp) == "2026-07-05 01:00:00.500000"
    assert [r.mag_raw for r in got if r.source_file_index == 4] == [50000.0, 50002.0]


def test_base_files_of_all_formats(spark, tmp_path):
    (tmp_path / "k.csv").write_text("1,50000.5,x,오전 12:00:01,07/15/26,y\n2,50001.5,x,오후 1:00:00,07/15/26,y")
    (tmp_path / "cyg20260716s.txt").write_text("00 00 05 1 2 3 50010.5\n00 00 06 1 2 3 50011.5")
    (tmp_path / "t.csv").write_text("Timestamp,Mag_nT\n2026-07-17 00:00:00,50020\n2026-07-17 00:00:00,50021")
    got = loaders.load_base(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [(str(r.timestamp), r.mag, r.date_assumed) for r in got] == [
        ("2026-07-15 00:00:01", 50000.5, False), ("2026-07-15 13:00:00", 50001.5, False), ("2026-07-16 00:00:05", 50010.5, False), ("2026-07-16 00:00:06", 50011.5, False), ("2026-07-17 00:00:00", 50020.0, False),
    ]


def test_observatory_file(spark, tmp_path):
    head = [(" IAGA CODE", "CYG"), (" Station Name", "Cheongyang"), (" Geodetic Latitude", "36.370"), (" Geodetic Longitude", "240.0"), (" Elevation", "165"), (" Reported", "HDZF")]
    text = "\n".join(f"{a:<24}{b:<45}|" for a, b in head) + "\nDATE       TIME         DOY     CYGH      CYGD      CYGZ      CYGF   |\n2026-07-15 00:00:00.000 196     30000.00      1.00  40000.00  50000.50\n2026-07-15 00:01:00.000 196     30000.00      1.00  40000.00  99999.00\n2026-07-15 00:02:00.000 196     99999.00      1.00  40000.00  99999.00\n"
    (tmp_path / "cyg.min").write_text(text)
    got = loaders.load_iaga(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [r.mag for r in got] == [50000.5, 50000.0, None] and got[0].iaga_code == "CYG" and got[0].lon == -120.0 and got[0].elevation_m == 165


def test_binary_and_text_exports():
    v = np.array([[1.0, np.nan], [3.0, 4.0], [5.0, 6.0]])
    grd = sinks.surfer_grd(v, 100.0, 200.0, 10.0)
    assert struct.unpack("<4shh6d", grd[:56]) == (b"DSBB", 2, 3, 100.0, 110.0, 200.0, 220.0, 1.0, 6.0)
    tif = sinks.geotiff(v, 100.0, 200.0, 10.0, 32652)
    at = struct.unpack("<I", tif[4:8])[0]
    tags = {t[0]: t for t in struct.iter_unpack("<HHII", tif[at + 2 : at + 2 + 12 * struct.unpack("<H", tif[at : at + 2])[0]])}
    data = np.frombuffer(tif[tags[273][3] : tags[273][3] + tags[279][3]], "<f4").reshape(3, 2)
    assert list(data[0]) == [5, 6] and np.isnan(data[2, 1])
    assert sinks.bln([(0, 0), (1, 0), (1, 1)]).decode().splitlines()[0] == "4,1"
    assert "MultiGeometry" in sinks.kml([[(1, 2), (3, 4), (5, 6)]] * 2) and "MultiGeometry" not in sinks.kml([[(1, 2), (3, 4), (5, 6)]])
    for kind, shapes in (("point", [(127.0, 36.0), (128.0, 37.0)]), ("polygon", [[[(0, 0), (1, 0), (1, 1)]], [[(5, 5), (6, 5), (6, 6)]]])):
        z = zipfile.ZipFile(io.BytesIO(sinks.shapefile(kind, shapes, {"id": [1, 2], "name": ["a", None]})))
        shp, shx, dbf = (z.read(f"layer.{e}") for e in ("shp", "shx", "dbf"))
        assert struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) and struct.unpack(">i", shx[24:28])[0] * 2 == len(shx) == 100 + 16
        assert struct.unpack("<I", dbf[4:8])[0] == 2
    assert "not evaluated" in sinks.report_markdown({"Noise": {}})


def test_project_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "point_id long, mag_raw double")
    sinks.save_project({"points": df}, str(tmp_path / "p"), {"cell": 10})
    tables, settings = sinks.load_project(spark, str(tmp_path / "p"))
    assert tables["points"].collect() == df.collect() and settings == {"cell": 10}


def test_images_show_data_and_leave_gaps_clear():
    import zlib

    v = np.array([[0.0, 5.0, np.nan], [10.0, 2.5, 7.5]])
    rgba = sinks.coloured(v, [(0, 0, 0), (200, 100, 0)])
    assert rgba[0, 1].tolist() == [100, 50, 0, 255] and rgba[0, 2, 3] == 0 and rgba[1, 0].tolist() == [200, 100, 0, 255]
    image = sinks.png(rgba)
    at = image.index(b"IDAT")
    size = struct.unpack(">I", image[at - 4 : at])[0]
    lines = np.frombuffer(zlib.decompress(image[at + 4 : at + 4 + size]), np.uint8).reshape(2, 13)
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and (lines[1, 1:].reshape(3, 4) == rgba[0]).all()
    shaded = sinks.coloured(np.add.outer(np.arange(8.0), np.arange(8.0)), [(0, 0, 0), (255, 255, 255)], shade=True, cell=10.0)
    assert shaded.shape == (8, 8, 4) and shaded[..., :3].max() <= 255
    tiff = sinks.geotiff_coloured(rgba, 100.0, 200.0, 10.0, 32652)
    ifd = struct.unpack("<I", tiff[4:8])[0]
    tags = {t[0]: t for t in (struct.unpack("<HHII", tiff[ifd + 2 + 12 * k : ifd + 14 + 12 * k]) for k in range(struct.unpack("<H", tiff[ifd : ifd + 2])[0]))}
    assert tags[256][3] == 3 and tags[277][3] == 4 and tiff[tags[273][3] : tags[273][3] + 24] == rgba[::-1].tobytes()


def test_survey_reads_each_file_once_and_only_its_formats(spark, files):
    rows = loaders.text_rows(spark, files)
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in loaders.file_formats(rows).collect()}
    assert kinds["b.csv"] == "sensys_r1" and kinds["d.txt"] == "sensys_r3_raw" and kinds["g.csv"] == "generic"
    plan = loaders.load_survey(spark, files)._jdf.queryExecution().toString()
    assert "FileScan text" not in plan  # the lines have been written once
