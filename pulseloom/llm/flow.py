"""Min-cost flow by successive shortest paths with potentials, on integers."""

from __future__ import annotations

import heapq


class Network:
    """A directed network; edges keep their index, so that their flow can be asked for."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        for start, end, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[start].append(len(self.to))
            self.to.append(end)
            self.room.append(room)
            self.cost.append(price)
        return len(self.to) - 2

    def flow(self, edge: int) -> int:
        return self.room[edge + 1]

    def solve(self, source: int, sink: int) -> tuple[int, int]:
        """Send as much as fits at the least cost; costs of edges are 0 or more. Returns flow and cost."""
        n = len(self.out)
        potential, sent, paid = [0] * n, 0, 0
        while True:
            distance: list[float] = [float("inf")] * n
            by = [-1] * n
            distance[source] = 0
            heap = [(0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > distance[u]:
                    continue
                for e in self.out[u]:
                    if self.room[e]:
                        v, reach = self.to[e], d + self.cost[e] + potential[u] - potential[self.to[e]]
                        if reach < distance[v]:
                            distance[v], by[v] = reach, e
                            heapq.heappush(heap, (reach, v))
            if by[sink] < 0:
                return sent, paid
            potential = [p + (int(d) if d < float("inf") else 0) for p, d in zip(potential, distance)]
            # All paths of this length at once: a blocking flow on edges without reduced cost.
            more = self._block(source, sink, potential)
            sent += more
            paid += more * (potential[sink] - potential[source])

    def _block(self, source: int, sink: int, potential: list[int]) -> int:
        """Depth-first blocking flow on edges of reduced cost 0, without recursion."""
        pushed = 0
        dead = [False] * len(self.out)
        while True:
            path, on, at = [], {source}, source
            position = {source: 0}
            while at != sink:
                k, edges = position[at], self.out[at]
                while k < len(edges):
                    e = edges[k]
                    v = self.to[e]
                    if self.room[e] and not dead[v] and v not in on and self.cost[e] + potential[at] == potential[v]:
                        break
                    k += 1
                position[at] = k
                if k == len(edges):
                    dead[at] = True
                    on.discard(at)
                    if not path:
                        return pushed
                    at = self.to[path.pop() ^ 1]
                    continue
                path.append(edges[k])
                at = self.to[edges[k]]
                on.add(at)
                position[at] = 0
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount
            pushed += amount
