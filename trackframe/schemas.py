"""Explicit schemas of every input; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = "0.1.0"
LABEL = "orbital-object candidate; identity unverified"


def ddl(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


FRAME_STRUCT = "struct<frame_index:int,image_ref:string,width_px:int,height_px:int,timestamp_s:double>"
SEQUENCE = (
    "schema_version string, sequence_id string, source_type string, profile string, "
    f"frames array<{FRAME_STRUCT}>, dataset_id string, dataset_version string, input_sha256 string"
)
POINT_LABEL = "sequence_id string, frame int, num_objects int, object_coords array<array<double>>"
DETECTION_STRUCT = (
    "struct<detection_id:string,frame_index:int,x_raw_px:double,y_raw_px:double,bbox_raw_px:array<double>,kind:string,"
    "quality_score:double,detector_name:string,x_reference_px:double,y_reference_px:double,"
    "endpoints_raw_px:array<array<double>>,evidence_statistics:map<string,double>>"
)
POINT_STRUCT = (
    "struct<frame_index:int,timestamp_s:double,x_reference_px:double,y_reference_px:double,x_raw_px:double,y_raw_px:double,"
    "point_type:string,detection_id:string,out_of_field:boolean>"
)
TRAJECTORY_STRUCT = (
    "struct<model:string,coordinate_frame:string,time_basis:string,vx:double,vy:double,speed:double,speed_unit:string,"
    "fit_rmse_px:double,observations_used:int,reference_epoch:double,x_at_epoch_px:double,y_at_epoch_px:double,"
    f"predictions:array<{POINT_STRUCT}>>"
)
TRACK_STRUCT = (
    "struct<track_id:string,status:string,candidate_label:string,"
    f"points:array<{POINT_STRUCT}>,observed_count:int,quality_score:double,warnings:array<string>,trajectory:{TRAJECTORY_STRUCT}>"
)
RESULT = (
    "schema_version string, job_id string, sequence_id string, source_type string, profile string, status string, detail string, time_basis string, "
    "coordinate_frame string, registration struct<status:string,warnings:array<string>>, "
    f"detections array<{DETECTION_STRUCT}>, tracks array<{TRACK_STRUCT}>, runtime_ms double, warnings array<string>, "
    "provenance struct<input_sha256:string,config_sha256:string,code_commit:string,dataset_version:string>"
)
RENDERED_TRUTH = (
    "sequence_id string, frames array<struct<frame_index:int,objects:array<struct<object_id:string,visible:boolean,reason:string,"
    "raw_xy_px:array<double>,reference_xy_px:array<double>,bbox_raw_px:array<double>>>>>"
)
CSV_COLUMNS = [
    "track_id", "frame_index", "point_type", "detection_id", "timestamp_s", "x_reference_px", "y_reference_px", "coordinate_frame", "time_basis",
]
