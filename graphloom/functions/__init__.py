"""Functions of the engine; every public function takes and returns DataFrames or Columns."""
