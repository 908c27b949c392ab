"""Fixed schemas of the track payload and the side tables."""

from __future__ import annotations

READ = "array<struct<style:string,score:double>>"

PAYLOAD = (
    "filename string, filepath string, title string, "
    "tags struct<tag:map<string,string>,tech:map<string,string>>, "
    "styles array<struct<parent:string,style:string,score:double>>, "
    f"salience {READ}, custom {READ}, "
    "frames array<array<array<string>>>, segments array<string>, "
    "bpm double, bpm_confidence double, key_strength double, duration double, "
    "key string, scale string, camelot string, waveform array<double>, "
    "override string, weights map<string,int>, drops array<string>, "
    f"relabel struct<styles:{READ},head:string,at:double,method:string>, "
    "neighbor_check struct<flag:boolean,confidence:double,suggested_family:string,suggested_style:string,agreement:double,top_sim:double>"
)

# What a listing reads; frames and waveforms, most of a payload, are not built.
LISTING = (
    "tags struct<tag:map<string,string>,tech:map<string,string>>, styles array<struct<parent:string,style:string,score:double>>, "
    "bpm double, key string, scale string, camelot string, duration double"
)

TRACK_COLUMNS = (
    "hash string, filename string, filepath string, title string, payload string, embedding binary, created double"
)
