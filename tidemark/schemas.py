"""Schemas of the tables that the operators exchange."""

from __future__ import annotations

BOX = "struct<class_id:int,x_center:double,y_center:double,width:double,height:double>"
CORNERS = "struct<x1:double,y1:double,x2:double,y2:double,conf:double,cls:int>"
IMAGES = (
    "dataset string, split string, path string, filename string, width int, height int, "
    f"is_corrupt boolean, is_negative boolean, boxes array<{BOX}>, sha256 string, dhash bigint"
)
FRAMES = (
    "filename string, path string, category string, video_id string, frame_index int, sequence_length int, "
    "width int, height int, fire_boxes int, smoke_boxes int, is_negative boolean"
)
TRACKS = (
    "stream_id string, frame_index bigint, ts_sec double, image_w int, image_h int, "
    "x1 double, y1 double, x2 double, y2 double, track_id int, conf double, cls int"
)
ALARMS = (
    "stream_id string, frame_index bigint, ts_sec double, stage int, disposition string, alarm boolean, "
    "alert_reason string, alert_at double, hazard_score double, confirmed_tracks array<int>, "
    "transitions array<struct<stage:int,track_id:int,reason:string>>, error string"
)
REVIEW_FLAG = (
    "struct<id:string,frame_index:int,timestamp_sec:double,issue:string,box_index:int,notes:string,updated_utc:string>"
)
