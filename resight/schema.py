"""Schemas of the engine's tables. Readers use them instead of inference, as `session` holds numbers, dates and names."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType


def _struct(**fields: object) -> StructType:
    return StructType([StructField(k, v, True) for k, v in fields.items()])


_S, _I, _B, _D = StringType(), IntegerType(), BooleanType(), DoubleType()

REGISTRY = _struct(
    frame_id=_S, cohort=_S, species=_S, role=_S, individual_id=_S, local_id=_I, session=_S, date=_S, date_source=_S, has_recapture=_B,
    n_sessions=_I, path_rel=_S, md5=_S, phash=_S, width=_I, height=_I, stage=_S, stage_source=_S, notes=_S,
)
SPLITS = _struct(frame_id=_S, cohort=_S, individual_id=_S, date=_S, session=_S, split_role=_S, split_fold=_S, interval_months=_D, is_open_new=_B, in_train_pool=_B)
CROPS = _struct(frame_id=_S, cohort=_S, crop_path=_S, seg_method=_S, mask_area_frac=_D, has_label=_B)
SIDES = _struct(frame_id=_S, yellow_frac=_D, ventral_score=_D, side=_S, axis=_S)
NEAR_DUPLICATES = _struct(cohort=_S, dist=_I, a=_S, b=_S, same_individual=_B)
DROPPED = _struct(drop=_S, keep=_S)
LAB_BENCHMARK = _struct(
    individual_id=_I, variant=_I, session_date=_S, n_sessions=_I, role=_S, gallery_session=_S, interval_days=_I, interval_months=_D, interval_bin=_S,
    filename=_S, md5=_S, abs_path=_S, stem_raw=_S,
)
FEATURES = _struct(frame_id=_S, pts=ArrayType(_struct(x=FloatType(), y=FloatType())), des=ArrayType(ArrayType(FloatType())))
EMBEDDINGS = _struct(frame_id=_S, emb=ArrayType(FloatType()))
CALIBRATION = _struct(lo=_D, hi=_D, method=_S, n_genuine=_I, n_impostor=_I)

#: Cohorts that have calendar dates; the others have numbered sessions.
DATED = ("TK", "LAB", "GCN")
#: Fixed values, as data in the field holds them: species and role by cohort, image files, names that are no photos.
SPECIES = {"TK": "Triturus karelinii", "PW": "Pleurodeles waltl", "LAB": "unknown (см. заказчик)", "GCN": "Triturus cristatus"}
ROLES = {"TK": "target", "PW": "target", "LAB": "temporal_aux", "GCN": "external"}
IMAGE_TYPES = ("jpg", "jpeg", "png")
SKIPPED_NAMES = ("пояснение.txt", "иллюстрация.jpg", ".ds_store")
INTERVAL_BINS = ("~1мес", "2-3мес", "4-5мес")
