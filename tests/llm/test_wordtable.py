"""What the word table's passes hold in memory."""

import gc

import pyarrow as pa

from blocklens.llm import wordtable


class Direct:
    def mapInArrow(self, run, schema):
        return run


def test_a_pass_holds_one_chunk_at_a_time():
    text = "x " * (wordtable.CHUNK_BYTES // 2 + 1)
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([text]), pa.array([True])], names=["doc_id", "text", "flag"]) for k in range(3)]
    for step in (wordtable.ask, wordtable.positions):
        live = []

        def words_of(raw):
            live.append(sum(isinstance(o, wordtable.Chunk) for o in gc.get_objects()))
            return [b"x"]
        assert sum(1 for _ in step(Direct(), words_of, 3)(iter(batches))) == 3
        assert max(live) == 1
