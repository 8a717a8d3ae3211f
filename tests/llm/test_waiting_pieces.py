import numpy as np

from shelfcast.llm.packing import Lane, Piece


def test_waiting_pieces_hold_their_own_ids_only():
    lane, whole = Lane(), np.arange(1_000_000, dtype="<u4")
    lane.add(Piece(1, 0, whole[10:20], 10))
    lane.add(Piece(2, 0, whole[100:5000], 4900))
    held = [p.ids for windows in lane.open.values() for pieces in windows for p in pieces]
    assert sorted(len(ids) for ids in held) == [10, 804]
    assert all(ids.base is None for ids in held)
