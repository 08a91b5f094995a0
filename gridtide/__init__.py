"""Time-series analytics on Spark DataFrames.

Every public function takes DataFrames (or Columns) and returns lazy DataFrames (or Columns); no
function collects data or keeps a session of its own.  Two rules keep the plans safe at scale:

* raw records are only ever reduced by aggregates that combine on the map side, so a key that holds
  a large part of the data does not end up in one task;
* window functions run on *grid* tables (one row per entity and calendar step), whose size per
  entity is bounded by the calendar, or on bounded sub-ranges of a group.
"""
